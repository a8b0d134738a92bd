"""Checks of life-science columns: which columns hold organisms, ontology terms or accessions, and what is wrong in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import one_of, trim
from sievework.operators import accession, taxonomy
from sievework.operators.validators import observation
from sievework.sources import ontology

# Names of columns that hold organisms.
ORGANISM_NAMES = ["organism", "host", "species", "taxon", "taxonomy", "taxa", "genus", "phylum", "class", "order", "family", "kingdom", "domain", "scientific_name", "scientificname", "organism_name", "organismname", "host_organism", "host_species", "host_taxid", "tax_id", "taxid", "ncbi_taxid", "ncbi_taxonomy_id"]
ORGANISM_PARTS, ORGANISM_ENDS = ["organism", "species", "taxon"], ["_species", "_organism", "_taxon", "_taxonomy", "_host"]
# Ontology, names of the columns that hold its terms, parts of such names.
ONTOLOGY_NAMES = [
    ("ENVO", ["env_broad_scale", "env_local_scale", "env_medium", "broad_scale_environmental_context", "local_environmental_context", "environmental_medium", "biome", "environment", "env_biome", "env_feature", "env_material", "habitat"], []),
    ("UBERON", ["tissue_type", "body_part", "sample_site", "organ", "body_habitat", "isolation_source"], ["body_site", "tissue", "anatomical"]),
    ("MONDO", ["condition", "health_status"], ["disease", "diagnosis"]),
]
# Type of accession, names of the columns that hold it, parts of such names.
ACCESSION_NAMES = [
    ("biosample", ["sample_accession", "sampleaccession"], ["biosample"]),
    ("sra_run", ["sra", "sra_accession"], ["sra_run", "run_accession", "srr", "err"]),
    ("sra_experiment", [], ["experiment_accession", "sra_experiment", "srx"]),
    ("bioproject", [], ["bioproject", "project_accession", "prjna", "prjeb"]),
    ("refseq", [], ["refseq", "ref_seq"]),
    ("genbank", [], ["genbank", "nucleotide"]),
    ("uniprot", [], ["uniprot", "swissprot"]),
    ("pdb", [], ["pdb", "structure"]),
    ("gene_id", ["gene_id", "geneid", "entrez_id", "entrezid"], []),
]
# Addresses of entries; {} stands for the accession.
URLS = {
    "biosample": "https://www.ncbi.nlm.nih.gov/biosample/{}", "sra_run": "https://www.ncbi.nlm.nih.gov/sra/{}", "sra_experiment": "https://www.ncbi.nlm.nih.gov/sra/{}",
    "sra_sample": "https://www.ncbi.nlm.nih.gov/sra/{}", "sra_study": "https://www.ncbi.nlm.nih.gov/sra/{}", "bioproject": "https://www.ncbi.nlm.nih.gov/bioproject/{}",
    "genbank": "https://www.ncbi.nlm.nih.gov/nuccore/{}", "refseq": "https://www.ncbi.nlm.nih.gov/nuccore/{}", "uniprot": "https://www.uniprot.org/uniprotkb/{}",
    "pdb": "https://www.rcsb.org/structure/{}", "gene_id": "https://www.ncbi.nlm.nih.gov/gene/{}", "protein": "https://www.ncbi.nlm.nih.gov/protein/{}",
}
PLACEHOLDERS = ["missing", "not applicable", "na"]
#: An unknown organism is told only where there are few.
FEW_UNKNOWN = 5


def _holds(name: Column, parts: list[str]) -> Column:
    return one_of([F.lit(False), *[name.contains(p) for p in parts]])


def holds_organisms(column: Column) -> Column:
    n = F.lower(column)
    return n.isin(ORGANISM_NAMES) | _holds(n, ORGANISM_PARTS) | one_of([n.endswith(e) for e in ORGANISM_ENDS])


def ontology_of(column: Column) -> Column:
    """The ontology whose terms a column of this name should hold, or null."""
    n, out = F.lower(column), F.lit(None).cast("string")
    for name, exact, parts in reversed(ONTOLOGY_NAMES):
        also = (n.contains("env_") & n.contains("scale")) if name == "ENVO" else F.lit(False)
        out = F.when(n.isin(exact) | _holds(n, parts) | also, name).otherwise(out)
    return out


def accession_of(column: Column) -> Column:
    """The type of accession that a column of this name should hold, or null."""
    n, out = F.lower(column), F.lit(None).cast("string")
    for name, exact, parts in reversed(ACCESSION_NAMES):
        also = (n.contains("accession") & ~n.contains("sample")) if name == "genbank" else F.lit(False)
        out = F.when(n.isin(exact) | _holds(n, parts) | also, name).otherwise(out)
    return out


def accession_url(value: Column) -> Column:
    """The address of an accession's entry, null where it is none."""
    template = F.create_map(*[F.lit(x) for kv in URLS.items() for x in kv])[accession.accession_type(value)]
    return F.replace(template, F.lit("{}"), F.upper(trim(value)))


def _there(values: DataFrame, column: str) -> DataFrame:
    return values.filter((F.col("column") == column) & (F.col("value") != "") & ~F.lower("value").isin(PLACEHOLDERS))


def _told(found: DataFrame, where: Column, kind: str, severity: str, detector: str, sure: float, column: str, total: int, most: int | None = None) -> DataFrame:
    n = found.agg(F.sum(F.when(where, F.col("n")).otherwise(0)).alias("occurrences")).filter("occurrences > 0")
    n = n if most is None else n.filter(F.col("occurrences") <= most)
    return observation(n, kind, severity, detector, total, column=F.lit(column), confidence=sure)


def organism_observations(values: DataFrame, column: str, total: int, dictionary: DataFrame | None = None) -> DataFrame:
    """Abbreviations, wrong case, possible typos, and unknown names if there are at most five."""
    found, status = taxonomy.match(values, column, dictionary), F.col("status")
    kinds = [("abbreviation", "inconsistency", "warning", 0.95, None), ("case_error", "inconsistency", "warning", 0.90, None), ("possible_typo", "inconsistency", "warning", 0.70, None), ("unknown", "constraint_violation", "info", 0.50, FEW_UNKNOWN)]
    return reduce(DataFrame.unionByName, [_told(found, status == s, kind, level, "taxonomy_validator", sure, column, total, most) for s, kind, level, sure, most in kinds])


def term_status(values: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """value, n, status (valid, unknown_term or invalid_format of ids; mapped or unmapped texts) and id.
    Ids may be of any ontology; texts are mapped to the one that the column's name asks for."""
    own = _there(values, column).select("value", "n")
    is_id = F.col("value").contains(":") & F.col("value").rlike("[0-9]")
    known = terms.select(F.upper("id").alias("key"), F.lit(True).alias("known"))
    ids = own.filter(is_id).join(known, F.upper("value") == F.col("key"), "left")
    family = one_of([F.upper("value").startswith(f"{name}:") for name, _, _ in ONTOLOGY_NAMES])
    of_ids = ids.select("value", "n", F.when(F.col("known"), "valid").when(family, "unknown_term").otherwise("invalid_format").alias("status"), F.when(F.col("known"), F.col("key")).alias("id"))
    texts = own.filter(~is_id)
    own_terms = terms.filter(F.col("id").startswith(F.coalesce(F.concat(ontology_of(F.lit(column)), F.lit(":")), F.lit(""))))
    of_texts = texts.join(suggest(texts, own_terms), "value", "left").select("value", "n", F.when(F.col("id").isNotNull(), "mapped").otherwise("unmapped").alias("status"), "id")
    return of_ids.unionByName(of_texts)


def suggest(values: DataFrame, terms: DataFrame) -> DataFrame:
    """value, id, confidence: the surest term of each text: by label 1, by synonym 0.95, else 0.7 if a label holds all of
    the text's words.  Only distinct texts without an exact term meet labels, on the longest word's first three letters
    among all three-letter pieces of the labels, so that no text is held against every label."""
    exact = ontology.lookup(values, terms)
    text = F.lower(F.trim("value"))
    left = values.select("value").distinct().join(exact.select("value"), "value", "left_anti").select("value", F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("words"))
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("size"), w.alias("word"))))["word"]
    keyed = left.filter(F.size("words") > 0).select("value", "words", F.substring(longest, 1, 3).alias("piece"))
    labels = terms.select("id", F.lower("label").alias("label")).withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("label"), F.lit(1)))))
    pieces = labels.withColumn("piece", F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda m: F.substring("label", F.col("at"), m)))).select("id", "label", "piece").distinct()
    met = keyed.join(pieces, "piece").filter(F.forall("words", lambda w: F.contains(F.col("label"), w)))
    partial = met.groupBy("value").agg(F.min("id").alias("id")).select("value", "id", F.lit(0.7).alias("confidence"))
    return exact.unionByName(partial)


def ontology_observations(values: DataFrame, column: str, terms: DataFrame, total: int) -> DataFrame:
    """Texts that could be written as ids, texts without any term, and ids that are none."""
    found, status = term_status(values, column, terms), F.col("status")
    kinds = [(status == "mapped", "inconsistency", "warning", 0.8), (status == "unmapped", "constraint_violation", "info", 0.5), (status.isin("unknown_term", "invalid_format"), "pattern_violation", "error", 0.9)]
    return reduce(DataFrame.unionByName, [_told(found, where, kind, level, "ontology_validator", sure, column, total) for where, kind, level, sure in kinds])


def accession_observations(values: DataFrame, column: str, expected: str, total: int) -> DataFrame:
    """Values that are no accession, or one of another type than the column's name says."""
    return _told(_there(values, column), accession.accession_type(F.col("value")) != expected, "pattern_violation", "warning", "accession_validator", 0.9, column, total)


def column_observations(values: DataFrame, columns: list[str], total: int, terms: DataFrame) -> DataFrame:
    """All checks of the columns whose names ask for organisms, ontology terms or accessions."""
    named = values.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    kinds = named.select("column", holds_organisms(F.col("column")).alias("organisms"), ontology_of(F.col("column")).alias("ontology"), accession_of(F.col("column")).alias("accession")).collect()  # names of columns
    found = [organism_observations(values, k.column, total) for k in kinds if k.organisms]
    found += [ontology_observations(values, k.column, terms, total) for k in kinds if k.ontology]
    found += [accession_observations(values, k.column, k.accession, total) for k in kinds if k.accession]
    return reduce(DataFrame.unionByName, found) if found else observation(values.filter("false").select("column", F.col("n").alias("occurrences")), "none", "info", "taxonomy_validator", total, confidence=0.0)


# What the first values of a body-site column say about the package.
BODY_SITES = [("human-gut", ["gut", "stool", "fecal", "intestin"]), ("human-skin", ["skin", "dermal"]), ("human-oral", ["oral", "saliva", "mouth"])]


def detected_package(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row, package: what names of columns say, and for human samples the first ten values of the body-site column."""
    low = [c.lower() for c in columns]
    if not {"host_subject_id", "subject_id", "patient_id"} & set(low):
        name = "water" if {"depth", "salinity"} <= set(low) else "soil" if {"soil_type", "ph"} & set(low) else None
        return rows.sparkSession.createDataFrame([(name,)], "package string")
    site = next((c for c in columns if any(p in c.lower() for p in ("body_site", "tissue", "sample_site"))), None)
    if site is None:
        return rows.sparkSession.createDataFrame([("human-associated",)], "package string")
    v, told = F.lower(f"`{site}`"), F.lit(None).cast("string")
    for name, parts in reversed(BODY_SITES):
        told = F.when(_holds(v, parts), name).otherwise(told)
    first = rows.orderBy("_row_id").limit(10).select("_row_id", told.alias("p"))
    return first.agg(F.coalesce(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("_row_id"))), F.lit("human-associated")).alias("package"))


def readiness_observations(ready: DataFrame) -> DataFrame:
    """Observations of a row of submission_readiness: what blocks is an error, the rest warnings."""
    kinds = [("n_duplicate", "inconsistency", "error", 0.95), ("n_bad_organism", "constraint_violation", "error", 0.95), ("n_bad_date", "pattern_violation", "warning", 0.85), ("n_bad_place", "pattern_violation", "warning", 0.85), ("n_bad_null", "inconsistency", "warning", 0.85), ("n_mismatch", "constraint_violation", "warning", 0.85)]
    rows = [F.struct(F.lit(kind).alias("type"), F.lit(level).alias("severity"), F.lit(c[2:]).alias("column"), F.lit("sample_validator").alias("detector"), F.lit(sure).alias("confidence"), F.col(c).cast("long").alias("occurrences"), F.round(F.col(c) * 100.0 / F.col("samples"), 4).alias("percentage")) for c, kind, level, sure in kinds if c in ready.columns]
    return ready.select(F.inline(F.array(*rows))).filter("occurrences > 0")
