"""The domain tables as projections of the star-schema tables, and the same in SQL.

Customers are samples, ordered parts are variant calls, part sizes are alleles, events are masks,
region, nation and customer form a tree, documents are sketched.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triloom.functions import ids
from triloom.operators import kmer
from triloom.schema import UNKNOWN_TYPE
from triloom.session import bounded_tasks
from triloom.view import IndexView

REFERENCE = "genome"


#: What the example queries ask for and a stored index, by application and folder: the tables do not change.
_KEPT: dict[tuple, object] = {}


class Tables(IndexView):
    """Lazy domain tables of one folder; nothing runs before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        bounded_tasks(spark, sf_dir)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").cast("long").alias("sample_id"), F.col("c_name").alias("sample_name"))

    @cached_property
    def metadata(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast("long").alias("sample_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("int").alias("nation"), F.col("c_acctbal").cast("double").alias("balance")
        )

    @cached_property
    def _lines(self) -> DataFrame:
        """What is shuffled is numbers only: texts are made of rows that are left."""
        unknown = ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("unknown")
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", (F.col("l_suppkey") % 5).cast("int").alias("seq"), "l_linenumber", unknown)
        od = self.raw("orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("sample_id"))
        return li.join(od, li.l_orderkey == od.o_orderkey)

    @cached_property
    def calls(self) -> DataFrame:
        """Rows are made distinct by the numbers that they are made of."""
        n = F.col("l_partkey")
        deletion = F.when(F.col("unknown"), 1).otherwise(1 + n % 3).cast("int")
        own = self._lines.select("sample_id", "seq", "l_partkey", F.coalesce("unknown", F.lit(False)).alias("unknown")).distinct()
        t = own.select(
            "sample_id",
            F.concat(F.lit("chr"), F.col("seq").cast("string")).alias("sequence"),
            (n + 1).cast("int").alias("position"),
            deletion.alias("deletion"),
            F.when(F.col("unknown"), "?").otherwise(F.substring(F.lit("ACGT"), (1 + n % 4).cast("int"), F.lit(1))).alias("insertion"),
            F.when(F.col("unknown"), UNKNOWN_TYPE).when(deletion == 1, "SNP").otherwise("INDEL").alias("var_type"),
        )
        return t.withColumn("spdi", ids.spdi_format(F.col("sequence"), F.col("position"), F.col("deletion"), F.col("insertion")))

    @cached_property
    def features(self) -> DataFrame:
        return self.calls.withColumnRenamed("spdi", "feature")

    @cached_property
    def mlst(self) -> DataFrame:
        part = self.raw("part").select("p_partkey", "p_brand", "p_size")
        place = self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        place = place.select(F.col("c_custkey").cast("long").alias("sample_id"), F.col("r_name").alias("scheme"))
        t = self._lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(place, "sample_id")
        allele = F.when(F.col("unknown"), "?").otherwise(F.col("p_size").cast("string"))
        return t.groupBy("sample_id", "scheme", F.col("p_brand").alias("locus")).agg(F.min(allele).alias("allele"))

    @cached_property
    def mlst_features(self) -> DataFrame:
        return self.mlst.withColumn("feature", ids.mlst_id(F.col("scheme"), F.col("locus"), F.col("allele")))

    @cached_property
    def annotations(self) -> DataFrame:
        """One annotation a called variant, from its part."""
        return self.annotated(self.calls.where(F.col("var_type") != UNKNOWN_TYPE).select("spdi", "sequence", "position", "deletion", "insertion", "var_type").distinct(), "inner")

    def annotated(self, variants: DataFrame, how: str = "left") -> DataFrame:
        """Variants, one row each, with their annotations; unknown positions have none."""
        known = F.col("var_type") != UNKNOWN_TYPE
        impact = F.element_at(F.array(*[F.lit(x) for x in ("HIGH", "MODERATE", "LOW", "MODIFIER")]), (F.col("p_size") % 4 + 1).cast("int"))
        impact = F.when(F.col("p_size").isNotNull(), impact)
        t = variants.join(self.raw("part"), (F.col("position") - 1 == F.col("p_partkey")) & known, how).select(
            *variants.columns,
            F.col("p_type").alias("annotation"),
            impact.alias("impact"),
            F.col("p_brand").alias("gene_name"),
            F.col("p_name").alias("gene_id"),
            F.when(F.col("p_partkey").isNotNull(), F.concat(F.lit("c."), F.col("p_size").cast("string"), F.lit("N>"), F.col("insertion"))).alias("hgvs_c"),
            F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("p."), F.col("p_size").cast("string"), F.col("insertion"))).alias("hgvs_p"),
        )
        s, g = F.col("sequence"), F.col("gene_id")
        return t.withColumns({"id_hgvs_c": ids.hgvs_id(s, g, F.col("hgvs_c")), "id_hgvs_p": ids.hgvs_id(s, g, F.col("hgvs_p"))})

    @cached_property
    def annotation_rows(self) -> DataFrame:
        """Several annotations a variant, as a parsed ANN field holds them."""
        own = self._lines.where("not unknown").select("l_orderkey", "seq", "l_partkey", (F.col("l_linenumber") % 4).alias("line")).distinct()
        return own.select(
            F.concat(F.lit("chr"), F.col("seq").cast("string"), F.lit(":"), (F.col("l_partkey") + 1).cast("string")).alias("variant_id"),
            F.element_at(F.array(*[F.lit(x) for x in ("HIGH", "MODERATE", "LOW", "MODIFIER")]), (F.col("line") + 1).cast("int")).alias("impact"),
            F.element_at(F.array(*[F.lit(x) for x in ("missense_variant", "synonymous_variant", "stop_gained", "odd&mixed")]), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("annotation"),
            F.concat((F.col("l_orderkey") % 97).cast("string"), F.lit("/"), (F.col("l_orderkey") % 89).cast("string")).alias("cdna"),
            F.col("l_orderkey").cast("long").alias("ann_id"),
        )

    @cached_property
    def masks(self) -> DataFrame:
        e = self.raw("events")
        start = F.col("user_id").cast("long") * 100 + F.col("event_id") % 50
        return e.select(F.col("user_id").cast("long").alias("sample_id"), F.col("event_type").alias("sequence"), start.cast("long").alias("start0"), (start + 1 + F.col("event_id") % 40).cast("long").alias("end0"))

    @cached_property
    def sequences(self) -> DataFrame:
        """(sequence, length, bases): base i is letter 1 + i % 4 of ACGT, three beyond the last position."""
        n = self.calls.groupBy("sequence").agg((F.max("position") + 3).cast("int").alias("length"))
        return n.withColumn("bases", F.substring(F.repeat(F.lit("CGTA"), (F.col("length") / 4 + 1).cast("int")), F.lit(1), F.col("length")))

    @cached_property
    def tree(self) -> DataFrame:
        c = self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        dist = F.col("r_regionkey") + 1 + F.col("n_nationkey") % 7 + 1
        w = Window.orderBy("r_regionkey", "n_nationkey", "c_custkey")
        leaf = c.select(
            F.col("c_name").alias("name"), (F.col("c_custkey") % 11 + 1).cast("double").alias("branch_length"), (dist + F.col("c_custkey") % 11 + 1).cast("double").alias("root_dist"), F.row_number().over(w).cast("int").alias("lft"), "r_name", "n_name", "r_regionkey", "n_nationkey"
        )
        span = [F.min("lft").alias("lft"), F.max("lft").alias("rgt")]
        first = lambda depth, *by: F.concat_ws(":", F.lit(depth), F.min("lft").over(Window.partitionBy(*by)))
        nation = leaf.groupBy(F.col("n_name").alias("name"), "n_nationkey", "r_regionkey").agg(*span).select("name", (F.col("n_nationkey") % 7 + 1).cast("double").alias("branch_length"), (F.col("r_regionkey") + 2 + F.col("n_nationkey") % 7).cast("double").alias("root_dist"), "lft", "rgt", F.lit(2).alias("depth"), F.lit(False).alias("is_leaf"), first(1, "r_regionkey").alias("parent_id"))
        region = leaf.groupBy(F.col("r_name").alias("name"), "r_regionkey").agg(*span).select("name", (F.col("r_regionkey") + 1).cast("double").alias("branch_length"), (F.col("r_regionkey") + 1).cast("double").alias("root_dist"), "lft", "rgt", F.lit(1).alias("depth"), F.lit(False).alias("is_leaf"), F.lit("0:1").alias("parent_id"))
        root = leaf.agg(*span).select(F.lit("root").alias("name"), F.lit(0.0).alias("branch_length"), F.lit(0.0).alias("root_dist"), "lft", "rgt", F.lit(0).alias("depth"), F.lit(False).alias("is_leaf"), F.lit(None).cast("string").alias("parent_id"))
        leaves = leaf.select("name", "branch_length", "root_dist", "lft", F.col("lft").alias("rgt"), F.lit(3).alias("depth"), F.lit(True).alias("is_leaf"), first(2, "r_regionkey", "n_nationkey").alias("parent_id"))
        nodes = leaves.union(nation).union(region).union(root)
        return nodes.select(F.lit("tree").alias("tree_id"), "*", F.concat_ws(":", "depth", "lft").alias("node_id"))

    @cached_property
    def sketch(self) -> DataFrame:
        return kmer.text_sketch(self.raw("documents").select(F.col("doc_id").alias("sample_id"), "text"))

    @cached_property
    def references(self) -> DataFrame:
        """(reference_name, sequence): two references over the sequences."""
        return self.calls.select("sequence").distinct().select(F.when(F.col("sequence") < "chr3", "genome").otherwise("plasmid").alias("reference_name"), "sequence")

    def _kept(self, name: str, make):
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _KEPT:
            _KEPT[key] = make()
        return _KEPT[key]

    def top(self, n: int = 3) -> list[str]:
        """The n most frequent variants, ties by id: what the example queries ask for."""
        def find() -> list[str]:
            rows = self.calls.where(F.col("var_type") != UNKNOWN_TYPE).groupBy("spdi").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "spdi").limit(100).collect()
            return [r["spdi"] for r in rows]

        return self._kept("top", find)[:n]

    def top_mlst(self) -> str:
        return self._kept("top mlst", lambda: self.mlst_features.where("allele <> '?'").groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").first()["feature"])

    def stored(self, *names: str):
        """The named tables as a stored index, each written once an application and folder. Calls and alleles are
        unique by their keys as they are made; references are read from the stored calls."""
        from triloom.index import SampleIndex
        from triloom.session import shared_folder

        index = SampleIndex(self.spark, self._kept("stored", lambda: shared_folder(self.spark, "index")))

        def references() -> None:
            own = Tables(self.spark, self.dir)
            own.calls = self.stored("calls").calls
            seqs = own.sequences.join(own.references, "sequence")
            index.append("reference_sequences", seqs.select("reference_name", F.col("sequence").alias("sequence_name"), "length", F.col("bases").alias("sequence")))

        make = {
            "samples": lambda: index.append("samples", self.samples),
            "calls": lambda: index.append("calls", self.calls),
            "mlst": lambda: index.append("mlst", self.mlst),
            "annotations": lambda: index.add("annotations", self.annotations, True),
            "reference_sequences": references,
        }
        for name in names:
            self._kept(f"stored {name}", make[name])
        return index


_UNKNOWN = "(l_returnflag = 'R' AND l_linestatus = 'F')"
CTES = {
    "samples": "SELECT CAST(c_custkey AS BIGINT) AS sample_id, c_name AS sample_name FROM customer",
    "metadata": "SELECT CAST(c_custkey AS BIGINT) AS sample_id, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS INTEGER) AS nation, CAST(c_acctbal AS DOUBLE) AS balance FROM customer",
    "lines": f"SELECT l.*, CAST(o_custkey AS BIGINT) AS sample_id, {_UNKNOWN} AS unk FROM lineitem l JOIN orders ON l_orderkey = o_orderkey",
    "calls0": f"""SELECT DISTINCT sample_id, 'chr' || CAST(l_suppkey % 5 AS VARCHAR) AS sequence, CAST(l_partkey + 1 AS INTEGER) AS position,
  CAST(CASE WHEN unk THEN 1 ELSE 1 + l_partkey % 3 END AS INTEGER) AS deletion, CASE WHEN unk THEN '?' ELSE substring('ACGT', CAST(1 + l_partkey % 4 AS INTEGER), 1) END AS insertion,
  CASE WHEN unk THEN '{UNKNOWN_TYPE}' WHEN 1 + l_partkey % 3 = 1 THEN 'SNP' ELSE 'INDEL' END AS var_type FROM lines""",
    "calls": "SELECT *, sequence || ':' || position || ':' || deletion || ':' || insertion AS spdi FROM calls0",
    "mlst": """SELECT l.sample_id, r_name AS scheme, p_brand AS locus, min(CASE WHEN unk THEN '?' ELSE CAST(p_size AS VARCHAR) END) AS allele
  FROM lines l JOIN part ON l_partkey = p_partkey JOIN customer ON c_custkey = l.sample_id JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
    "mlstf": "SELECT *, 'mlst:' || scheme || ':' || locus || ':' || allele AS feature FROM mlst",
    "variants": f"SELECT DISTINCT spdi, sequence, position, deletion, insertion, var_type FROM calls WHERE var_type <> '{UNKNOWN_TYPE}'",
    "annotations0": """SELECT v.*, p_type AS annotation, ['HIGH', 'MODERATE', 'LOW', 'MODIFIER'][CAST(p_size % 4 + 1 AS INTEGER)] AS impact, p_brand AS gene_name, p_name AS gene_id,
  'c.' || p_size || 'N>' || insertion AS hgvs_c, CASE WHEN p_size % 2 = 0 THEN 'p.' || p_size || insertion END AS hgvs_p FROM variants v JOIN part ON position - 1 = p_partkey""",
    "annotations": "SELECT *, 'hgvs:' || sequence || ':' || gene_id || ':' || hgvs_c AS id_hgvs_c, 'hgvs:' || sequence || ':' || gene_id || ':' || hgvs_p AS id_hgvs_p FROM annotations0",
    "annrows": """SELECT DISTINCT 'chr' || CAST(l_suppkey % 5 AS VARCHAR) || ':' || CAST(l_partkey + 1 AS VARCHAR) AS variant_id, ['HIGH', 'MODERATE', 'LOW', 'MODIFIER'][CAST(l_linenumber % 4 + 1 AS INTEGER)] AS impact,
  ['missense_variant', 'synonymous_variant', 'stop_gained', 'odd&mixed'][CAST(l_orderkey % 4 + 1 AS INTEGER)] AS annotation, CAST(l_orderkey % 97 AS VARCHAR) || '/' || CAST(l_orderkey % 89 AS VARCHAR) AS cdna, CAST(l_orderkey AS BIGINT) AS ann_id FROM lines WHERE NOT unk""",
    "masks": "SELECT CAST(user_id AS BIGINT) AS sample_id, event_type AS sequence, CAST(user_id AS BIGINT) * 100 + event_id % 50 AS start0, CAST(user_id AS BIGINT) * 100 + event_id % 50 + 1 + event_id % 40 AS end0 FROM events",
    "sequences": "SELECT sequence, CAST(max(position) + 3 AS INTEGER) AS length, substring(repeat('CGTA', CAST(floor((max(position) + 3) / 4.0) AS INTEGER) + 1), 1, CAST(max(position) + 3 AS INTEGER)) AS bases FROM calls GROUP BY sequence",
    "leaf": """SELECT c_name AS name, CAST(c_custkey % 11 + 1 AS DOUBLE) AS branch_length, CAST(r_regionkey + 2 + n_nationkey % 7 + c_custkey % 11 + 1 AS DOUBLE) AS root_dist,
  CAST(row_number() OVER (ORDER BY r_regionkey, n_nationkey, c_custkey) AS INTEGER) AS lft, r_name, n_name, r_regionkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "tree": """SELECT name, branch_length, root_dist, lft, lft AS rgt, 3 AS depth, true AS is_leaf FROM leaf
  UNION ALL SELECT n_name, CAST(n_nationkey % 7 + 1 AS DOUBLE), CAST(r_regionkey + 2 + n_nationkey % 7 AS DOUBLE), min(lft), max(lft), 2, false FROM leaf GROUP BY n_name, n_nationkey, r_regionkey
  UNION ALL SELECT r_name, CAST(r_regionkey + 1 AS DOUBLE), CAST(r_regionkey + 1 AS DOUBLE), min(lft), max(lft), 1, false FROM leaf GROUP BY r_name, r_regionkey
  UNION ALL SELECT 'root', 0.0, 0.0, min(lft), max(lft), 0, false FROM leaf""",
    "docwords": "SELECT doc_id AS sample_id, list_filter(regexp_split_to_array(lower(text), '[ \\n]'), lambda x: x <> '') AS w FROM documents",
    "sketch": "SELECT DISTINCT sample_id, hash FROM (SELECT sample_id, md5(unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS hash FROM docwords WHERE len(w) >= 3) WHERE hash < '1'",
    "refs": "SELECT DISTINCT CASE WHEN sequence < 'chr3' THEN 'genome' ELSE 'plasmid' END AS reference_name, sequence FROM calls",
    "top": f"SELECT spdi, row_number() OVER (ORDER BY n DESC, spdi) AS rk FROM (SELECT spdi, count(*) AS n FROM calls WHERE var_type <> '{UNKNOWN_TYPE}' GROUP BY 1)",
    "topm": "SELECT feature, row_number() OVER (ORDER BY n DESC, feature) AS rk FROM (SELECT feature, count(*) AS n FROM mlstf WHERE allele <> '?' GROUP BY 1)",
}
_ORDER = list(CTES)


def sql(body: str, **more: str) -> str:
    """body behind a WITH of the domain tables it needs, directly or through others; more adds CTEs in order."""
    import re

    need: set[str] = set()
    todo = [body, *more.values()]
    while todo:
        text = todo.pop()
        for name in _ORDER:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(CTES[name])
    parts = [f"{n} AS ({CTES[n]})" for n in _ORDER if n in need and n not in more] + [f"{n} AS ({t})" for n, t in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
