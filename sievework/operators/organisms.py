"""The organisms that are known without a taxonomy dump."""

from __future__ import annotations

# Taxid, name, rank, common names.
ORGANISMS = """
9606 | Homo sapiens | species | human
10090 | Mus musculus | species | mouse; house mouse
10116 | Rattus norvegicus | species | rat; brown rat
9031 | Gallus gallus | species | chicken
7955 | Danio rerio | species | zebrafish
8364 | Xenopus tropicalis | species | western clawed frog
7227 | Drosophila melanogaster | species | fruit fly
6239 | Caenorhabditis elegans | species | C. elegans; roundworm
4932 | Saccharomyces cerevisiae | species | yeast; baker's yeast; budding yeast
4896 | Schizosaccharomyces pombe | species | fission yeast
3702 | Arabidopsis thaliana | species | thale cress
562 | Escherichia coli | species | E. coli
287 | Pseudomonas aeruginosa | species | P. aeruginosa
573 | Klebsiella pneumoniae | species | K. pneumoniae
550 | Enterobacter cloacae | species | E. cloacae
485 | Neisseria meningitidis | species | meningococcus
487 | Neisseria gonorrhoeae | species | gonococcus
210 | Helicobacter pylori | species | H. pylori
197 | Campylobacter jejuni | species | C. jejuni
590 | Salmonella enterica | species | Salmonella
623 | Shigella flexneri | species | S. flexneri
666 | Vibrio cholerae | species | cholera
727 | Haemophilus influenzae | species | H. influenzae
83333 | Escherichia coli K-12 | no rank | E. coli K-12; K-12
1280 | Staphylococcus aureus | species | S. aureus; staph
1282 | Staphylococcus epidermidis | species | S. epidermidis
1313 | Streptococcus pneumoniae | species | pneumococcus
1314 | Streptococcus pyogenes | species | S. pyogenes; GAS
1311 | Streptococcus agalactiae | species | S. agalactiae; GBS
1423 | Bacillus subtilis | species | B. subtilis
1428 | Bacillus thuringiensis | species | Bt
1392 | Bacillus anthracis | species | anthrax
1496 | Clostridioides difficile | species | C. difficile; C. diff
1502 | Clostridium perfringens | species | C. perfringens
1386 | Bacillus | genus |
1350 | Enterococcus faecalis | species | E. faecalis
1351 | Enterococcus faecium | species | E. faecium
1773 | Mycobacterium tuberculosis | species | TB; tuberculosis
1769 | Mycobacterium leprae | species | leprosy
1763 | Mycobacterium | genus |
817 | Bacteroides fragilis | species | B. fragilis
821 | Bacteroides vulgatus | species | B. vulgatus
818 | Bacteroides thetaiotaomicron | species | B. theta
816 | Bacteroides | genus |
853 | Faecalibacterium prausnitzii | species | F. prausnitzii
39491 | Eubacterium rectale | species | E. rectale
33039 | Ruminococcus bromii | species | R. bromii
1263 | Ruminococcus | genus |
216816 | Bifidobacterium longum | species | B. longum
1678 | Bifidobacterium | genus |
1680 | Bifidobacterium adolescentis | species | B. adolescentis
28116 | Bacteroides ovatus | species | B. ovatus
28118 | Bacteroides uniformis | species | B. uniformis
29466 | Prevotella copri | species | P. copri
838 | Prevotella | genus |
1578 | Lactobacillus | genus |
1598 | Lactobacillus reuteri | species | L. reuteri
1613 | Lactobacillus fermentum | species | L. fermentum
47715 | Lactobacillus rhamnosus | species | L. rhamnosus; LGG
1590 | Lactobacillus plantarum | species | L. plantarum
1610 | Lactobacillus delbrueckii | species | L. delbrueckii
33958 | Lactobacillus acidophilus | species | L. acidophilus
186826 | Lactobacillus casei | species | L. casei
29375 | Akkermansia muciniphila | species | A. muciniphila
239935 | Akkermansia | genus |
46503 | Dialister invisus | species | D. invisus
39778 | Enterobacteriaceae | family |
1303 | Streptococcus oralis | species | S. oralis
1304 | Streptococcus salivarius | species | S. salivarius
1338 | Streptococcus sanguinis | species | S. sanguinis
1305 | Streptococcus mutans | species | S. mutans
837 | Porphyromonas gingivalis | species | P. gingivalis
851 | Fusobacterium nucleatum | species | F. nucleatum
28132 | Prevotella intermedia | species | P. intermedia
712 | Pasteurella multocida | species | P. multocida
1747 | Cutibacterium acnes | species | P. acnes; Propionibacterium acnes
29388 | Corynebacterium | genus |
1718 | Corynebacterium diphtheriae | species | diphtheria
38289 | Malassezia | genus |
76773 | Malassezia globosa | species | M. globosa
303 | Pseudomonas | genus |
294 | Pseudomonas fluorescens | species | P. fluorescens
286 | Pseudomonas syringae | species | P. syringae
1279 | Staphylococcus | genus |
1301 | Streptococcus | genus |
1760 | Actinobacteria | phylum |
1236 | Gammaproteobacteria | class |
1224 | Proteobacteria | phylum |
1239 | Firmicutes | phylum |
976 | Bacteroidetes | phylum |
632 | Yersinia pestis | species | plague
773 | Listeria monocytogenes | species | L. monocytogenes; listeria
777 | Legionella pneumophila | species | Legionnaire's
446 | Legionella | genus |
90371 | Salmonella enterica subsp. enterica | subspecies |
813 | Chlamydia trachomatis | species | chlamydia
782 | Rickettsia | genus |
780 | Rickettsia prowazekii | species | typhus
833 | Treponema pallidum | species | syphilis
293 | Bradyrhizobium japonicum | species | B. japonicum
2157 | Archaea | superkingdom |
2287 | Methanobacterium | genus |
2190 | Methanosarcina | genus |
183968 | Methanobrevibacter smithii | species | M. smithii
4751 | Fungi | kingdom | fungi
5476 | Candida albicans | species | C. albicans; candida
5478 | Candida tropicalis | species | C. tropicalis
5482 | Candida glabrata | species | C. glabrata
5475 | Candida | genus |
5062 | Aspergillus fumigatus | species | A. fumigatus
5061 | Aspergillus niger | species | A. niger
5052 | Aspergillus | genus |
5141 | Neurospora crassa | species | N. crassa; red bread mold
746128 | Aspergillus fumigatus Af293 | no rank |
10239 | Viruses | superkingdom | virus
11103 | Hepatitis C virus | species | HCV
10298 | Human alphaherpesvirus 1 | species | HSV-1; herpes simplex 1
10310 | Human alphaherpesvirus 2 | species | HSV-2; herpes simplex 2
10359 | Human gammaherpesvirus 4 | species | EBV; Epstein-Barr
10376 | Human betaherpesvirus 5 | species | CMV; cytomegalovirus
11676 | Human immunodeficiency virus 1 | species | HIV-1; HIV
211044 | Influenza A virus | species | influenza A; flu A
11320 | Influenza A virus (A/Puerto Rico/8/1934(H1N1)) | no rank | PR8
2697049 | Severe acute respiratory syndrome coronavirus 2 | species | SARS-CoV-2; COVID-19
694009 | Severe acute respiratory syndrome-related coronavirus | species | SARS-CoV
12814 | Respiratory syncytial virus | species | RSV
12637 | Rotavirus | genus | rotavirus
10632 | Tobacco mosaic virus | species | TMV
10665 | Bacteriophage T4 | species | T4 phage
10710 | Lambda phage | species | bacteriophage lambda
408170 | human gut metagenome | no rank | gut metagenome
412755 | marine metagenome | no rank |
410658 | soil metagenome | no rank |
433733 | human skin metagenome | no rank | skin metagenome
447426 | human oral metagenome | no rank | oral metagenome
749907 | human vaginal metagenome | no rank | vaginal metagenome
556182 | freshwater metagenome | no rank |
652676 | hypersaline lake metagenome | no rank |
527639 | wastewater metagenome | no rank |
410657 | air metagenome | no rank |
428143 | human lung metagenome | no rank | lung metagenome
870726 | human milk metagenome | no rank | milk metagenome
4577 | Zea mays | species | corn; maize
4530 | Oryza sativa | species | rice
4565 | Triticum aestivum | species | wheat; bread wheat
3847 | Glycine max | species | soybean
3750 | Malus domestica | species | apple
4081 | Solanum lycopersicum | species | tomato
4113 | Solanum tuberosum | species | potato
3760 | Prunus persica | species | peach
"""
