"""Scalar functions over identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.functions import ids
from triloom.operators.bases import with_bases
from triloom.operators.features import restore_names
from triloom.plans.projection import Tables
from triloom.plans.registry import query

C = F.col


def _spdi(t: Tables) -> DataFrame:
    return t.calls.select("spdi").distinct()


def _bases(t: Tables) -> DataFrame:
    """Ids with the deletion spelled out, from the reference sequences."""
    v = t.calls.where("insertion <> '?'").select("spdi", "sequence", "position", "deletion", "insertion").distinct()
    return with_bases(v, t.sequences, C("position"), C("deletion"), "deleted").withColumn("spdi_ref", F.concat_ws(":", "sequence", "position", "deleted", "insertion"))


_V = "SELECT v.*, substring(bases, position, deletion) AS deleted, v.sequence || ':' || position || ':' || substring(bases, position, deletion) || ':' || insertion AS spdi_ref FROM variants v JOIN sequences USING (sequence)"


@query("spdi_parse", "SELECT DISTINCT spdi, split_part(spdi, ':', 1) AS sequence, CAST(split_part(spdi, ':', 2) AS INTEGER) AS position, split_part(spdi, ':', 3) AS deletion, split_part(spdi, ':', 4) AS insertion FROM calls")
def _(t: Tables) -> DataFrame:
    return _spdi(t).withColumn("p", ids.spdi_parse(C("spdi"))).select("spdi", "p.*")


@query("spdi_format", "SELECT DISTINCT spdi FROM calls")
def _(t: Tables) -> DataFrame:
    return t.calls.select(ids.spdi_format(C("sequence"), C("position"), C("deletion"), C("insertion")).alias("spdi")).distinct()


@query("spdi_normalize", "SELECT spdi_ref, spdi FROM v", v=_V)
def _(t: Tables) -> DataFrame:
    return _bases(t).select("spdi_ref", ids.spdi_normalize(C("spdi_ref")).alias("spdi"))


@query("spdi_to_spdi_ref", "SELECT spdi, spdi_ref FROM v", v=_V)
def _(t: Tables) -> DataFrame:
    return _bases(t).select("spdi", "spdi_ref")


@query("spdi_start_stop", "SELECT spdi, position AS start, position + deletion AS stop, position - 1 AS start0, position + deletion - 1 AS stop0 FROM variants")
def _(t: Tables) -> DataFrame:
    v = t.calls.where("insertion <> '?'").select("spdi", "position", "deletion").distinct()
    p, d = C("position"), C("deletion")
    return v.select("spdi", p.alias("start"), (p + d).alias("stop"), (p - 1).alias("start0"), (p + d - 1).alias("stop0"))


@query("to_unknown", "SELECT spdi, sequence || ':' || position || ':' || deletion || ':?' AS unknown FROM variants")
def _(t: Tables) -> DataFrame:
    return t.calls.where("insertion <> '?'").select("spdi").distinct().withColumn("unknown", ids.to_unknown(C("spdi")))


@query("to_unknown_explode", "SELECT spdi, sequence || ':' || unnest(range(position, position + deletion)) || ':1:?' AS unknown FROM variants")
def _(t: Tables) -> DataFrame:
    v = t.calls.where("insertion <> '?'").select("spdi", "sequence", F.explode(ids.unknown_positions(C("position"), C("deletion"))).alias("p")).distinct()
    return v.select("spdi", F.concat(C("sequence"), F.lit(":"), C("p").cast("string"), F.lit(":1:?")).alias("unknown"))


@query("is_unknown_feature", "SELECT var_type = 'UNKNOWN_MISSING' AS is_unknown, count(*) AS n FROM calls GROUP BY 1 UNION ALL SELECT allele = '?', count(*) FROM mlst GROUP BY 1")
def _(t: Tables) -> DataFrame:
    a = t.calls.groupBy(ids.is_unknown(C("var_type")).alias("is_unknown")).agg(F.count("*").alias("n"))
    return a.union(t.mlst.groupBy(ids.is_unknown_allele(C("allele")).alias("is_unknown")).agg(F.count("*").alias("n")))


@query("hgvs_id", "SELECT spdi, id_hgvs_c, id_hgvs_p FROM annotations")
def _(t: Tables) -> DataFrame:
    return t.annotations.select("spdi", "id_hgvs_c", "id_hgvs_p")


@query("hgvs_gn_id", "SELECT spdi, 'hgvs_gn:' || sequence || ':' || gene_name || ':' || hgvs_c AS id_c, 'hgvs_gn:' || sequence || ':' || gene_name || ':' || hgvs_p AS id_p FROM annotations")
def _(t: Tables) -> DataFrame:
    s, g = C("sequence"), C("gene_name")
    return t.annotations.select("spdi", ids.hgvs_gn_id(s, g, C("hgvs_c")).alias("id_c"), ids.hgvs_gn_id(s, g, C("hgvs_p")).alias("id_p"))


@query("hgvs_kind", "SELECT spdi, CASE WHEN starts_with(v, 'p.') THEN 'protein' WHEN starts_with(v, 'c.') THEN 'nucleotide' END AS kind FROM (SELECT spdi, coalesce(hgvs_p, hgvs_c) AS v FROM annotations)")
def _(t: Tables) -> DataFrame:
    return t.annotations.select("spdi", ids.hgvs_kind(F.coalesce("hgvs_p", "hgvs_c")).alias("kind"))


@query("mlst_id", "SELECT DISTINCT feature FROM mlstf")
def _(t: Tables) -> DataFrame:
    return t.mlst.select(ids.mlst_id(C("scheme"), C("locus"), C("allele")).alias("feature")).distinct()


@query("feature_dispatch", "SELECT kind, count(*) AS n FROM (SELECT 'spdi' AS kind FROM variants UNION ALL SELECT 'mlst' FROM (SELECT DISTINCT feature FROM mlstf) UNION ALL SELECT 'hgvs' FROM annotations) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    v = t.calls.where("insertion <> '?'").select(C("spdi").alias("id")).distinct()
    v = v.union(t.mlst_features.select("feature").distinct()).union(t.annotations.select("id_hgvs_c"))
    return v.groupBy(ids.feature_kind(C("id")).alias("kind")).agg(F.count("*").alias("n"))


@query("percent", "SELECT sequence, CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM calls) AS DOUBLE) * 100.0 AS percent FROM calls GROUP BY 1")
def _(t: Tables) -> DataFrame:
    n = t.calls.count()
    return t.calls.groupBy("sequence").agg(ids.percent(F.count("*"), F.lit(n)).alias("percent"))


@query(
    "constellation_mutation_id",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'NC:' || p_partkey || ':C:T' WHEN 1 THEN 'hgvs_gn:NC:S:p.Y' || p_partkey || 'del' WHEN 2 THEN 'hgvs_gn:NC:S:p.N' || p_partkey || 'Y'
WHEN 3 THEN 'NC:' || (1 + p_size % 8) || ':' || substring('CGTACGTACGT', CAST(1 + p_size % 8 AS INTEGER), CAST(2 + p_size % 3 AS INTEGER)) || ':' || substring('CGTACGTACGT', CAST(1 + p_size % 8 AS INTEGER), 1) WHEN 4 THEN 'hgvs_gn:NC:ORF8:p.Q' || p_size || '*' END AS id FROM part""",
)
def _(t: Tables) -> DataFrame:
    """A site for each part, of six kinds; the last names no gene."""
    kinds = ["concat('nuc:C', p_partkey, 'T')", "concat('s:Y', p_partkey, '-')", "concat('S:N', p_partkey, 'Y')", "concat('del:', 1 + p_size % 8, ':', 1 + p_size % 3)", "concat('8:Q', p_size, '*')", "concat('x:A', p_size, 'B')"]
    site = F.element_at(F.array(*[F.expr(k) for k in kinds]), (C("p_partkey") % 6 + 1).cast("int"))
    return t.raw("part").select("p_partkey", ids.constellation_id(site, "NC", F.lit("CGTACGTACGT")).alias("id"))


_AA = "SELECT DISTINCT upper(substring(c_name, 1, 1 + c_nationkey % 3)) || c_custkey || '-' AS m, upper(substring(c_name, 1, 1 + c_nationkey % 3)) AS a, c_custkey AS p, 1 + c_nationkey % 3 AS n FROM customer"


@query("aa_deletion_name", "SELECT m, CASE WHEN n = 1 THEN a || p || 'del' ELSE substring(a, 1, 1) || p || '_' || substring(a, CAST(n AS INTEGER), 1) || (p + n - 1) || 'del' END AS name FROM aa", aa=_AA)
def _(t: Tables) -> DataFrame:
    a = F.upper(F.substring("c_name", F.lit(1), (1 + C("c_nationkey") % 3).cast("int")))
    m = t.raw("customer").select(F.concat(a, C("c_custkey").cast("string"), F.lit("-")).alias("m")).distinct()
    return m.withColumn("name", ids.aa_deletion_name(C("m")))


@query("sanitize_name", "SELECT DISTINCT p_name, regexp_replace(p_name, '[^A-Za-z0-9_.\\-]', '__', 'g') AS safe FROM part")
def _(t: Tables) -> DataFrame:
    return t.raw("part").select("p_name", ids.sanitize_name(C("p_name")).alias("safe")).distinct()


@query("restore_names_join", "SELECT DISTINCT p_partkey, p_name FROM part")
def _(t: Tables) -> DataFrame:
    p = t.raw("part").select("p_partkey", "p_name")
    data = p.select("p_partkey", ids.sanitize_name(C("p_name")).alias("safe"))
    return restore_names(data, "safe", p.select("p_name"), "p_name").select("p_partkey", "p_name").distinct()


_FILES = "SELECT '/data/' || replace(c_name, '#', '_') || ['.fasta.gz', '.fq', '_1.fastq.gz', '_R2.fastq'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS path FROM customer"
_NAME = "regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.(gz|xz|bz2)$', ''), '\\.(fasta|fa|fna|fastq|fq|gb|gbk|gbff)$', '')"


def _paths(t: Tables) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(x) for x in (".fasta.gz", ".fq", "_1.fastq.gz", "_R2.fastq")]), (C("c_custkey") % 4 + 1).cast("int"))
    return t.raw("customer").select(F.concat(F.lit("/data/"), F.replace("c_name", F.lit("#"), F.lit("_")), end).alias("path"))


@query("genome_name", f"SELECT path, {_NAME} AS name FROM fs", fs=_FILES)
def _(t: Tables) -> DataFrame:
    return _paths(t).select("path", ids.genome_name(C("path")).alias("name"))


@query("sample_from_filename", "SELECT path, split_part(regexp_extract(path, '([^/]*)$', 1), '.', 1) AS sample FROM fs", fs=_FILES)
def _(t: Tables) -> DataFrame:
    return _paths(t).select("path", ids.sample_from_filename(C("path")).alias("sample"))


@query("validate_allele", "SELECT DISTINCT a, CASE WHEN regexp_matches(a, '^[0-9]+$') THEN a ELSE '?' END AS allele FROM (SELECT unnest(['INF-2', 'LNF', '51+', '-', '12', CAST(p_size AS VARCHAR)]) AS a FROM part)")
def _(t: Tables) -> DataFrame:
    a = t.raw("part").select(F.explode(F.array(*[F.lit(x) for x in ("INF-2", "LNF", "51+", "-", "12")], C("p_size").cast("string"))).alias("a")).distinct()
    return a.withColumn("allele", ids.validate_allele(C("a")))


@query("persistence_name", "SELECT sample_id, md5(sample_name) AS name FROM samples")
def _(t: Tables) -> DataFrame:
    return t.samples.select("sample_id", ids.persistence_name(C("sample_name")).alias("name"))


@query("status_label", "SELECT sample_id, CASE WHEN sample_id % 3 = 2 THEN 'Present' WHEN sample_id % 3 = 1 THEN 'Unknown' ELSE 'Absent' END AS label FROM samples")
def _(t: Tables) -> DataFrame:
    return t.samples.select("sample_id", ids.status_label((C("sample_id") % 3).cast("int")).alias("label"))


@query("size_unit", "SELECT doc_id, n_chars / 1024.0 AS kb, n_chars / 1048576.0 AS mb FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", ids.size_in_unit(C("n_chars"), "KB").alias("kb"), ids.size_in_unit(C("n_chars"), "MB").alias("mb"))


@query("fill_type_tag", "SELECT spdi_ref, CASE WHEN length(deleted) = 1 THEN 'SNP' ELSE 'INDEL' END AS type FROM v", v=_V)
def _(t: Tables) -> DataFrame:
    return _bases(t).select("spdi_ref", ids.variant_type(C("deleted"), C("insertion")).alias("type"))
