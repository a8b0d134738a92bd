"""The ontology terms that are known without an OBO file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, label, synonyms.
TERMS = """
ENVO:00000446 | terrestrial biome | land biome
ENVO:00000447 | marine biome | ocean biome; sea biome
ENVO:00000873 | freshwater biome | freshwater
ENVO:01000174 | forest biome | forest
ENVO:01000175 | woodland biome | woodland
ENVO:01000176 | shrubland biome | shrubland
ENVO:01000177 | grassland biome | grassland; prairie
ENVO:01000178 | savanna biome | savanna
ENVO:01000179 | desert biome | desert
ENVO:01000180 | tundra biome | tundra
ENVO:01000181 | mangrove biome | mangrove
ENVO:01000219 | anthropogenic terrestrial biome | urban biome; agricultural biome
ENVO:01000246 | village biome | village
ENVO:01000248 | dense settlement biome | city; urban area
ENVO:00000067 | cave | cave system
ENVO:00000073 | building | structure
ENVO:00000076 | mine | mining site
ENVO:00000114 | agricultural field | farm field; cropland
ENVO:00000233 | beach | shoreline
ENVO:00000384 | river bed | riverbed
ENVO:00002006 | lake shore | lakeshore
ENVO:00002007 | sediment | sediment layer
ENVO:00002030 | aquatic environment | aquatic
ENVO:00002031 | wastewater | sewage
ENVO:00002034 | biofilm | microbial mat
ENVO:00002149 | salt lake | saline lake
ENVO:00002150 | coastal water | coastal
ENVO:00002151 | sea water | seawater; ocean water
ENVO:00002228 | hospital environment | hospital; clinical environment
ENVO:00003074 | constructed habitat | built environment
ENVO:00001998 | soil | dirt; earth
ENVO:00002001 | water | aqueous
ENVO:00002003 | feces | fecal matter; stool
ENVO:00002005 | air | atmosphere
ENVO:00002010 | sediment |
ENVO:00002011 | sludge | biosolids
ENVO:00002012 | compost | composted material
ENVO:00002016 | hypersaline water | brine
ENVO:00002042 | surface water |
ENVO:00002044 | groundwater | ground water
ENVO:00002045 | drinking water | potable water
ENVO:00002148 | wetland | marsh; swamp
ENVO:00002261 | forest soil | woodland soil
ENVO:00002262 | agricultural soil | farm soil; crop soil
ENVO:00005789 | human gut | intestinal content; gut content
ENVO:00005792 | saliva | oral fluid
ENVO:00010505 | mucus | mucosal secretion
ENVO:01000155 | organic material | organic matter
ENVO:01000306 | urine |
ENVO:01000321 | blood |
ENVO:02000033 | rhizosphere | root zone
ENVO:00002259 | sand |
ENVO:00002018 | clay |
UBERON:0000160 | intestine | gut; bowel
UBERON:0000945 | stomach | gastric
UBERON:0000955 | brain | cerebral
UBERON:0000970 | eye | ocular
UBERON:0000990 | reproductive system | genital
UBERON:0001004 | respiratory system | respiratory tract
UBERON:0001007 | digestive system | gastrointestinal tract; GI tract
UBERON:0001009 | circulatory system | cardiovascular system
UBERON:0001013 | adipose tissue | fat tissue
UBERON:0001016 | nervous system | neural
UBERON:0001043 | esophagus | oesophagus
UBERON:0001052 | rectum | rectal
UBERON:0001088 | urine | urinary
UBERON:0001134 | skeletal muscle tissue | muscle
UBERON:0001155 | colon | large intestine
UBERON:0001264 | pancreas | pancreatic
UBERON:0001474 | bone element | bone
UBERON:0001836 | saliva | oral fluid
UBERON:0001911 | mammary gland | breast
UBERON:0001988 | feces | stool; fecal matter
UBERON:0002048 | lung | pulmonary
UBERON:0002097 | skin of body | skin; dermal
UBERON:0002106 | spleen | splenic
UBERON:0002107 | liver | hepatic
UBERON:0002110 | gall bladder | gallbladder
UBERON:0002113 | kidney | renal
UBERON:0002114 | duodenum | duodenal
UBERON:0002115 | jejunum | jejunal
UBERON:0002116 | ileum | ileal
UBERON:0002367 | prostate gland | prostate
UBERON:0002370 | thymus | thymic
UBERON:0002371 | bone marrow | marrow
UBERON:0003126 | trachea | windpipe
UBERON:0006314 | body fluid | biological fluid
UBERON:0000178 | blood | peripheral blood
UBERON:0001456 | face | facial
UBERON:0001637 | artery | arterial
UBERON:0001913 | milk | breast milk
UBERON:0000996 | vagina | vaginal
UBERON:0000995 | uterus | uterine
UBERON:0001245 | anus | anal
UBERON:0001707 | nasal cavity | nose; nasal
UBERON:0001723 | tongue | lingual
UBERON:0001729 | oropharynx | throat
UBERON:0001982 | hair | scalp hair
UBERON:0003104 | urethra | urethral
UBERON:0018707 | bladder organ | urinary bladder
UBERON:0000341 | throat | pharynx
UBERON:0000948 | heart | cardiac
MONDO:0005011 | Crohn disease | Crohn's disease; CD; regional enteritis
MONDO:0005265 | inflammatory bowel disease | IBD
MONDO:0005101 | ulcerative colitis | UC
MONDO:0005052 | irritable bowel syndrome | IBS
MONDO:0000861 | colorectal cancer | colon cancer; CRC
MONDO:0005170 | gastric cancer | stomach cancer
MONDO:0001974 | gastritis |
MONDO:0004992 | celiac disease | coeliac disease; celiac sprue
MONDO:0005015 | diabetes mellitus | diabetes
MONDO:0005148 | type 2 diabetes mellitus | T2D; type 2 diabetes
MONDO:0005147 | type 1 diabetes mellitus | T1D; type 1 diabetes
MONDO:0011122 | obesity |
MONDO:0004974 | liver disease | hepatic disease
MONDO:0005359 | non-alcoholic fatty liver disease | NAFLD
MONDO:0005267 | heart disease | cardiac disease
MONDO:0005068 | myocardial infarction | heart attack; MI
MONDO:0001134 | coronary artery disease | CAD
MONDO:0005044 | hypertension | high blood pressure
MONDO:0005091 | atherosclerosis |
MONDO:0004975 | Alzheimer disease | Alzheimer's disease; AD
MONDO:0007739 | Huntington disease | Huntington's disease; HD
MONDO:0005180 | Parkinson disease | Parkinson's disease; PD
MONDO:0004985 | multiple sclerosis | MS
MONDO:0001071 | depression | major depressive disorder; MDD
MONDO:0008315 | autism spectrum disorder | autism; ASD
MONDO:0005623 | autoimmune disease | autoimmunity
MONDO:0005294 | rheumatoid arthritis | RA
MONDO:0001014 | lupus | systemic lupus erythematosus; SLE
MONDO:0005520 | multiple sclerosis | MS
MONDO:0011649 | psoriasis |
MONDO:0100096 | COVID-19 | coronavirus disease 2019; SARS-CoV-2 infection
MONDO:0005109 | HIV infection | HIV/AIDS; AIDS
MONDO:0018076 | tuberculosis | TB
MONDO:0005812 | influenza | flu
MONDO:0004609 | hepatitis B | HBV infection
MONDO:0004610 | hepatitis C | HCV infection
MONDO:0005737 | Ebola hemorrhagic fever | Ebola
MONDO:0005070 | neoplasm | cancer; malignancy; malignant neoplasm
MONDO:0008903 | lung cancer | lung carcinoma
MONDO:0006256 | breast cancer | breast carcinoma
MONDO:0005115 | prostate carcinoma | prostate cancer
MONDO:0001056 | leukemia |
MONDO:0024880 | melanoma |
MONDO:0004979 | asthma |
MONDO:0005002 | chronic obstructive pulmonary disease | COPD
MONDO:0002254 | pneumonia |
MONDO:0001490 | cystic fibrosis | CF
MONDO:0005027 | allergy | allergic disease
MONDO:0005364 | atopic dermatitis | eczema
MONDO:0021113 | osteoarthritis | OA
MONDO:0005298 | osteoporosis |
MONDO:0002462 | periodontitis | periodontal disease; gum disease
"""


def terms(spark: SparkSession) -> DataFrame:
    """id, label, synonyms."""
    entries = [tuple(part.strip() for part in line.split("|")) for line in TERMS.strip().splitlines()]
    return spark.createDataFrame([(i, label, [s for s in more.split("; ") if s]) for i, label, more in entries], "id string, label string, synonyms array<string>")


def by_ontology(known: DataFrame) -> DataFrame:
    return known.groupBy(F.substring_index("id", ":", 1).alias("ontology")).agg(F.count_distinct("id").alias("n"))
