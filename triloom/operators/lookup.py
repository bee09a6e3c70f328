"""Status of features per sample: found and unknown calls resolved in one pass over the call tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.functions import ids
from triloom.schema import ABSENT, BIN, PRESENT, UNKNOWN, UNKNOWN_ALLELE, UNKNOWN_TYPE


def _status(found: Column, unknown: Column) -> Column:
    """Found and unknown at once is unknown."""
    return F.when(F.max(unknown.cast("int")) == 1, UNKNOWN).when(F.max(found.cast("int")) == 1, PRESENT).otherwise(ABSENT)


def at(calls: DataFrame, sequence: str, first: int, last: int) -> Column:
    """Calls on a sequence from position first to last; in terms of the folders too, where the calls
    lie in folders (a column `bin`), so that others are not even listed."""
    here = (F.col("sequence") == sequence) & F.col("position").between(first, last)
    return here & F.col("bin").between(first // BIN, last // BIN) if "bin" in calls.columns else here


def spdi_status(calls: DataFrame, f: ids.Spdi) -> DataFrame:
    """(sample_id, status): present with the call, unknown where a deleted position is unknown."""
    found = (F.col("position") == f.position) & (F.col("deletion") == f.deletion) & (F.col("insertion") == f.insertion)
    unknown = (F.col("var_type") == UNKNOWN_TYPE) & F.col("position").between(f.position, f.stop - 1)
    hit = calls.where(at(calls, f.sequence, f.position, max(f.position, f.stop - 1)) & (found | unknown))
    return hit.groupBy("sample_id").agg(_status(found, unknown).alias("status"))


def _binned(calls: DataFrame, sites: DataFrame) -> tuple[DataFrame, list[str]]:
    """Sites (sequence, position, ...) with what else they can be joined to calls by: folders that no
    site needs are pruned while the query runs."""
    if "bin" not in calls.columns:
        return sites, ["sequence", "position"]
    return sites.withColumn("bin", F.floor(F.col("position") / BIN).cast("int")), ["sequence", "bin", "position"]


def variants_status(calls: DataFrame, variants: DataFrame) -> DataFrame:
    """(sample_id, status) of the union of several variants (sequence, position, deletion, insertion)."""
    v = variants.select("sequence", "position", "deletion", "insertion").distinct()
    here, keys = _binned(calls, v)
    found = calls.join(here, [*keys, "deletion", "insertion"], "left_semi").select("sample_id", F.lit(True).alias("found"), F.lit(False).alias("unk"))
    gone, keys = _binned(calls, v.select("sequence", F.explode(ids.unknown_positions(F.col("position"), F.col("deletion"))).alias("position")).distinct())
    unknown = calls.where(F.col("var_type") == UNKNOWN_TYPE).join(gone, keys, "left_semi").select("sample_id", F.lit(False), F.lit(True))
    return found.union(unknown).groupBy("sample_id").agg(_status(F.col("found"), F.col("unk")).alias("status"))


def sites_status(calls: DataFrame, features: list[ids.Spdi]) -> DataFrame:
    """(site, sample_id, status) of many variants, numbered as listed, in one scan: the calls meet the
    sites' few positions by an equal join. A sample that says nothing of a site has no row for it."""
    rows = [(i, f.sequence, f.position, f.deletion, f.insertion) for i, f in enumerate(features)]
    sites = calls.sparkSession.createDataFrame(rows, "site int, sequence string, start int, gone int, put string")
    span = F.sequence("start", F.greatest(F.col("start"), F.col("start") + F.col("gone") - 1))
    sites, keys = _binned(calls, sites.withColumn("position", F.explode(span)))
    found = (F.col("position") == F.col("start")) & (F.col("deletion") == F.col("gone")) & (F.col("insertion") == F.col("put"))
    unknown = (F.col("var_type") == UNKNOWN_TYPE) & (F.col("gone") > 0)
    return calls.join(sites, keys).where(found | unknown).groupBy("site", "sample_id").agg(_status(found, unknown).alias("status"))


def hgvs_status(calls: DataFrame, annotations: DataFrame, f: ids.Hgvs) -> DataFrame:
    """All variants that carry the id count, by union."""
    column = "id_hgvs_c" if f.nucleotide else "id_hgvs_p"
    return variants_status(calls, annotations.where(F.col(column) == f.id))


def hgvs_gn_status(calls: DataFrame, annotations: DataFrame, f: ids.HgvsGn) -> DataFrame:
    column = "hgvs_c" if f.nucleotide else "hgvs_p"
    return variants_status(calls, annotations.where((F.col("sequence") == f.sequence) & (F.col("gene_name") == f.gene) & (F.col(column) == f.variant)))


def mlst_status(mlst: DataFrame, f: ids.Mlst) -> DataFrame:
    found, unknown = F.col("allele") == f.allele, F.col("allele") == UNKNOWN_ALLELE
    hit = mlst.where((F.col("scheme") == f.scheme) & (F.col("locus") == f.locus) & (found | unknown))
    return hit.groupBy("sample_id").agg(_status(found, unknown).alias("status"))


def spdi_list_status(calls: DataFrame, features: list[ids.Spdi]) -> DataFrame:
    """(sample_id, status) of the conjunction, in one scan and one aggregation: the least status over
    the features, absent where one says nothing."""
    def one(f: ids.Spdi) -> Column:
        here = at(calls, f.sequence, f.position, max(f.position, f.stop - 1))
        found = here & (F.col("position") == f.position) & (F.col("deletion") == f.deletion) & (F.col("insertion") == f.insertion)
        unknown = here & (F.col("var_type") == UNKNOWN_TYPE) & F.col("position").between(f.position, f.stop - 1)
        return F.when(unknown, UNKNOWN).when(found, PRESENT)

    each = [one(f) for f in features]
    # Of a sample's calls, unknown (1) beats present (2), so the least that is there counts.
    status = reduce(F.least, [F.coalesce(F.min(c), F.lit(ABSENT)) for c in each]) if len(each) > 1 else F.coalesce(F.min(each[0]), F.lit(ABSENT))
    near = reduce(lambda a, b: a | b, [at(calls, f.sequence, f.position, max(f.position, f.stop - 1)) for f in features])  # what the scan can use
    return calls.where(near).where(reduce(lambda a, b: a | b, [c.isNotNull() for c in each])).groupBy("sample_id").agg(status.alias("status"))


def unknown_pairs(calls: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, sample_id) where the sample is unknown at a deleted position of the feature, for all
    features (feature, sequence, position, deletion) in one equi join."""
    gone, keys = _binned(calls, features.select("feature", "sequence", F.explode(ids.unknown_positions(F.col("position"), F.col("deletion"))).alias("position")))
    unknown = calls.where(F.col("var_type") == UNKNOWN_TYPE).select(*keys, "sample_id")
    return gone.join(unknown, keys).select("feature", "sample_id").distinct()
