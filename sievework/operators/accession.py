"""Accession numbers of life-science archives, classified by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import trim

# Patterns of upper-cased accessions, tried in this order.
PATTERNS = [
    ("biosample", r"^SAM[NED][A-Z]?[0-9]{6,12}\z"),
    ("sra_run", r"^[SED]RR[0-9]{6,9}\z"),
    ("sra_experiment", r"^[SED]RX[0-9]{6,9}\z"),
    ("sra_sample", r"^[SED]RS[0-9]{6,9}\z"),
    ("sra_study", r"^[SED]RP[0-9]{6,9}\z"),
    ("bioproject", r"^PRJ[NED][A-Z]?[0-9]{4,8}\z"),
    ("refseq", r"^(N[MRPCTGWZ]|X[MRP]|Y[P])_[0-9]{6,9}(\.[0-9]+)?\z"),
    ("uniprot", r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})\z"),
    ("protein", r"^[A-Z]{3}[0-9]{5}(\.[0-9]+)?\z"),
    ("genbank", r"^[A-Z]{1,6}[0-9]{5,10}(\.[0-9]+)?\z"),
    ("pdb", r"^[0-9][A-Z][A-Z0-9]{2}\z|^[0-9][A-Z0-9][A-Z][A-Z0-9]\z|^[0-9][A-Z0-9]{2}[A-Z]\z"),
    ("gene_id", r"^[0-9]{1,10}\z"),
]


def accession_type(c: Column) -> Column:
    """The first type whose pattern fits, or invalid."""
    v, out = F.upper(trim(c)), F.lit("invalid")
    for name, pattern in reversed(PATTERNS):
        out = F.when(v.rlike(pattern), name).otherwise(out)
    return out


def accession_counts(values: DataFrame, column: str) -> DataFrame:
    """accession_type and the number of rows; blank cells count as neither."""
    there = values.filter((F.col("column") == column) & (trim(F.col("value")) != ""))
    return there.groupBy(accession_type(F.col("value")).alias("accession_type")).agg(F.sum("n").alias("n"))
