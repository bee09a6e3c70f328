"""Ingest and sinks on what the tables can stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.index import SampleIndex, new_samples
from triloom.operators import bitmaps
from triloom.plans.projection import Tables
from triloom.plans.registry import query
from triloom.session import shared_folder
from triloom.sources import readers

_LINES = "SELECT 'dir/' || c_name || '.fa' || chr(9) || 'scheme' || CAST(c_nationkey AS VARCHAR) || chr(9) || '-' || chr(9) || 'abc(' || c_custkey % 9 || ')' || chr(9) || 'bgl(' || CASE WHEN c_custkey % 5 = 0 THEN '?' ELSE c_custkey % 7 || '' END || ')' || chr(9) || 'ldh(-)' AS value FROM customer"


def _lines(t: Tables) -> DataFrame:
    return t.raw("customer").select(
        F.concat(
            F.lit("dir/"), "c_name", F.lit(".fa\tscheme"), F.col("c_nationkey").cast("string"), F.lit("\t-\tabc("), (F.col("c_custkey") % 9).cast("string"), F.lit(")\tbgl("),
            F.when(F.col("c_custkey") % 5 == 0, "?").otherwise((F.col("c_custkey") % 7).cast("string")), F.lit(")\tldh(-)"),
        ).alias("value")
    )


@query(
    "scan_mlst_tseemann",
    "SELECT split_part(regexp_extract(split_part(value, chr(9), 1), '([^/]*)$', 1), '.', 1) AS sample, split_part(value, chr(9), 2) AS scheme, regexp_extract(c, '^([^(]*)', 1) AS locus, CASE WHEN regexp_matches(regexp_extract(c, '\\((.*)\\)', 1), '^[0-9]+$') THEN regexp_extract(c, '\\((.*)\\)', 1) ELSE '?' END AS allele FROM (SELECT value, unnest(string_split(value, chr(9))[4:]) AS c FROM ml)",
    ml=_LINES,
)
def _(t: Tables) -> DataFrame:
    return readers.mlst_tseemann(_lines(t))


_WIDE = "SELECT c_name || '.fna' AS file, CAST(c_custkey % 9 AS VARCHAR) AS l1, CASE WHEN c_custkey % 4 = 0 THEN 'INF-' || c_custkey ELSE CAST(c_nationkey AS VARCHAR) END AS l2 FROM customer"
_MELT = "SELECT split_part(file, '.', 1) AS sample, '{s}' AS scheme, locus, CASE WHEN regexp_matches(allele, '^[0-9]+$') THEN allele ELSE '?' END AS allele FROM (SELECT file, 'l1' AS locus, l1 AS allele FROM wd UNION ALL SELECT file, 'l2', l2 FROM wd)"


def _wide(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.raw("customer").select(F.concat("c_name", F.lit(".fna")).alias("FILE"), (k % 9).cast("string").alias("l1"), F.when(k % 4 == 0, F.concat(F.lit("INF-"), k.cast("string"))).otherwise(F.col("c_nationkey").cast("string")).alias("l2"))


@query("scan_mlst_sistr", _MELT.format(s="sistr_330"), wd=_WIDE)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "sistr")
    _wide(t).write.csv(path, header=True)
    return readers.mlst_sistr(t.spark, path)


@query("scan_mlst_chewbbaca", _MELT.format(s="own"), wd=_WIDE)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "chewbbaca")
    _wide(t).write.csv(path, header=True, sep="\t")
    return readers.mlst_chewbbaca(t.spark, path, "own")


@query("melt", "SELECT file, 'm' AS scheme, 'l1' AS locus, l1 AS allele FROM wd UNION ALL SELECT file, 'm', 'l2', l2 FROM wd", wd=_WIDE)
def _(t: Tables) -> DataFrame:
    return readers.melt(_wide(t), "FILE", "m")


@query("scan_metadata", "SELECT sample_id, name, segment, nation, balance FROM metadata")
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "metadata")
    t.metadata.write.csv(path, header=True, sep="\t")
    m = readers.metadata(t.spark, path)
    return m.select(F.col("sample_id").cast("long").alias("sample_id"), "name", "segment", F.col("nation").cast("int").alias("nation"), F.col("balance").cast("double").alias("balance"))


@query("scan_kmer_fofn", 'SELECT c_name AS "Sample", unnest([c_name || \'_1.fq\', c_name || \'_2.fq\']) AS "File" FROM customer WHERE c_nationkey <> 3')
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "sketches")
    t.raw("customer").select(F.col("c_name").alias("Sample"), F.concat("c_name", F.lit("_1.fq,"), "c_name", F.lit("_2.fq")).alias("Files")).write.csv(path, header=True, sep="\t")
    return readers.kmer_fofn(t.spark, path, t.raw("customer").where("c_nationkey = 3").select(F.col("c_name").alias("sample_name")))


@query("scan_vcf_fofn", 'SELECT c_name AS "Sample", c_name || \'.vcf\' AS "VCF", CASE WHEN c_custkey % 3 <> 0 THEN c_name || \'.bed\' END AS "Mask File" FROM customer')
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "fofn")
    name = F.col("c_name")
    mask = F.when(F.col("c_custkey") % 3 == 0, "NA").otherwise(F.concat(name, F.lit(".bed")))
    t.raw("customer").select(name.alias("Sample"), F.concat(name, F.lit(".vcf")).alias("VCF"), mask.alias("Mask File")).write.csv(path, header=True, sep="\t")
    return readers.vcf_fofn(t.spark, path)


@query("insert_samples_batch", "SELECT max_id + row_number() OVER (ORDER BY sample_name) AS sample_id, sample_name FROM (SELECT s_name AS sample_name FROM supplier), (SELECT max(sample_id) AS max_id FROM samples)")
def _(t: Tables) -> DataFrame:
    names = t.raw("supplier").select(F.col("s_name").alias("sample_name")).union(t.samples.select("sample_name"))
    return new_samples(t.samples, names)


@query("index_features_upsert", "SELECT spdi, count(*) AS n FROM calls GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Two overlapping loads give what one load of all gives."""
    index = SampleIndex(t.spark, shared_folder(t.spark, "upsert"))
    index.add("calls", t.calls.where("sequence <> 'chr0'"))
    index.add("calls", t.calls.where("sequence <> 'chr1'"))
    return index.calls.groupBy("spdi").agg(F.count("*").alias("n"))


@query("merge_sample_sets", "SELECT spdi AS feature, count(DISTINCT sample_id) AS n FROM calls GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Samples with and without a positive balance; neither is the union."""
    rich = t.metadata.where("balance > 0")
    parts = [bitmaps.to_bitmaps(t.features.join(rich, "sample_id", how)) for how in ("left_semi", "left_anti")]
    return bitmaps.sizes(bitmaps.union_bitmaps(*parts))


@query("sample_sets_stored", "SELECT spdi, count(*) AS n FROM calls GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Counts of stored sets: built of one load, kept up by a second that overlaps it, then compacted."""
    index = SampleIndex(t.spark, shared_folder(t.spark, "sets"))
    index.add("calls", t.calls.where("sequence <> 'chr0'"))
    index.build_sets()
    index.add("calls", t.calls.where("sequence <> 'chr1'"))
    index.compact("sample_sets")
    return index.mutation_counts(include_unknown=True)


@query("sample_sets_listed", "SELECT spdi AS feature, sample_id FROM calls JOIN top USING (spdi) WHERE rk <= 5")
def _(t: Tables) -> DataFrame:
    """Samples of five variants from stored sets."""
    index = SampleIndex(t.spark, shared_folder(t.spark, "sets"))
    index.add("calls", t.calls, True)
    index.build_sets()
    return index.samples_of_features(t.spark.createDataFrame([(f,) for f in t.top(5)], "feature string"))


@query("select_random_sequences", "SELECT sequence FROM sequences ORDER BY md5('5:' || sequence), sequence LIMIT 2")
def _(t: Tables) -> DataFrame:
    return readers.random_sequences(t.sequences, 2, 5).select("sequence")


@query("scan_samples_tsv", 'SELECT c_name AS "Sample", c_name || \'.fa\' AS "Assemblies", \'none\' AS reads FROM customer')
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "sheet")
    name, none = F.col("c_name"), F.lit(None).cast("string")
    t.raw("customer").select(name.alias("Sample"), F.concat(name, F.lit(".fa")).alias("Assemblies"), none.alias("Reads1"), none.alias("Reads2")).write.csv(path, header=True, sep="\t")
    return readers.sample_sheet(t.spark, path).select("Sample", "Assemblies", F.coalesce("Reads1", "Reads2", F.lit("none")).alias("reads"))
