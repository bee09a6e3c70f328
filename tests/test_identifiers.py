import pytest
from pyspark.sql import functions as F

from triloom.functions import ids


@pytest.mark.parametrize(
    ("text", "kind", "same"),
    [
        ("seq:5:1:A", ids.Spdi, "seq:5:1:A"),
        ("seq:5:ACG:A", ids.Spdi, "seq:5:3:A"),
        ("seq:5:1:?", ids.Spdi, "seq:5:1:?"),
        ("hgvs:seq:gene:c.1A>T", ids.Hgvs, "hgvs:seq:gene:c.1A>T"),
        ("hgvs:seq:n.1A>T", ids.Hgvs, "hgvs:seq:n.1A>T"),
        ("hgvs_gn:seq:S:p.D614G", ids.HgvsGn, "hgvs_gn:seq:S:p.D614G"),
        ("mlst:ecoli:adk:100", ids.Mlst, "mlst:ecoli:adk:100"),
        ("mlst:ecoli:adk", ids.Mlst, "mlst:ecoli:adk:*"),
    ],
)
def test_parse(text, kind, same):
    f = ids.parse_feature(text)
    assert type(f) is kind and f.id == same


@pytest.mark.parametrize("text", ["ecoli:adk:100", "*:1:1:A", "seq:-1:1:A", "seq:1:x:A", "seq:1:1:u", "hgvs:seq:S:D614G", "mlst:*:adk:1", "mlst:e:*:1"])
def test_parse_errors(text):
    with pytest.raises(ids.FeatureError):
        ids.parse_feature(text)


def test_features_of_one_class():
    assert ids.same_class(["a:1:1:A", "a:2:1:C"]) is ids.Spdi
    with pytest.raises(ids.FeatureError):
        ids.same_class(["a:1:1:A", "mlst:a:b:1"])


# Facts the original's own tests hold.
SITES = {
    "s:HV69-": "hgvs_gn:NC_045512.2:S:p.H69_V70del",
    "s:Y144-": "hgvs_gn:NC_045512.2:S:p.Y144del",
    "nuc:C100T": "NC_045512.2:100:C:T",
    "del:1:2": "NC_045512.2:1:ATC:A",
    "orf1ab:SGF3675-": "hgvs_gn:NC_045512.2:ORF1ab:p.S3675_F3677del",
    "x:A1B": None,
    "del:0:2": None,
    "a:b:c:d": None,
}


def test_constellation_sites(spark):
    t = spark.createDataFrame([(s,) for s in SITES], "s string")
    got = {r["s"]: r["id"] for r in t.select("s", ids.constellation_id(F.col("s"), "NC_045512.2", F.lit("ATCG")).alias("id")).collect()}
    assert got == SITES


def test_scalar_columns(spark):
    t = spark.range(1)
    lit = F.lit
    row = t.select(
        ids.validate_allele(lit("51+")).alias("a"),
        ids.validate_allele(lit("68")).alias("b"),
        ids.sample_from_filename(lit("/x/S.1.fa")).alias("c"),
        ids.hgvs_id(lit("s"), lit("g"), lit("n.1A>T")).alias("d"),
        ids.hgvs_id(lit("s"), lit("g"), lit(None).cast("string")).alias("e"),
        ids.genome_name(lit("/d/x_1.fastq.gz"), True).alias("f"),
        ids.percent(lit(1), lit(0)).alias("g"),
        ids.variant_type(lit("A"), lit("T")).alias("h"),
        ids.variant_type(lit("AC"), lit("TG")).alias("i"),
        ids.variant_type(lit("AC"), lit("A")).alias("j"),
        ids.variant_type(lit("A"), lit("<DEL>")).alias("k"),
        ids.spdi_normalize(lit("s:1:ACG:T")).alias("l"),
        F.size(ids.unknown_positions(lit(5), lit(0))).alias("m"),
    ).first()
    assert tuple(row) == ("?", "68", "S", "hgvs:s:n.1A>T", None, "x", None, "SNP", "MNP", "INDEL", "OTHER", "s:1:3:T", 0)
