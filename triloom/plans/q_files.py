"""Readers and sinks: tables are written in a file format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.functions import ids
from triloom.index import SampleIndex
from triloom.operators import intervals, tree
from triloom.operators.bases import with_bases
from triloom.operators.features import restore_names
from triloom.operators.sample_set import SampleSet
from triloom.plans.projection import Tables
from triloom.plans.q_intervals import _merged
from triloom.plans.q_states import H1, h, q
from triloom.plans.q_trees import _newick
from triloom.plans.registry import query
from triloom.session import shared_folder, write_text, written
from triloom.sources import readers, sinks

C = F.col


def _written(t: Tables, lines: DataFrame, name: str) -> str:
    """Lines as text files; the path."""
    path = shared_folder(t.spark, name)
    lines.write.text(path)
    return path


_V = "SELECT v.*, substring(bases, position, deletion) AS ref FROM variants v JOIN sequences USING (sequence)"


def _with_ref(t: Tables) -> DataFrame:
    v = t.calls.where("insertion <> '?'").select("sequence", "position", "deletion", "insertion", "var_type").distinct()
    return with_bases(v, t.sequences, C("position"), C("deletion"))


def _vcf(t: Tables) -> str:
    v = _with_ref(t)
    line = F.concat_ws("\t", "sequence", C("position").cast("string"), F.lit("."), "ref", F.concat(C("insertion"), F.lit(",N")), F.lit("."), F.lit("."), F.concat(F.lit("DP=3;TYPE="), C("var_type")))
    return _written(t, v.select(line), "s.vcf")


@query("scan_vcf", "SELECT sequence AS chrom, position AS pos, ref, insertion AS alt, var_type AS type FROM v", v=_V)
def _(t: Tables) -> DataFrame:
    return readers.vcf(t.spark, _vcf(t)).select("chrom", "pos", "ref", "alt", "type")


def _bed(t: Tables, masks: DataFrame) -> str:
    return _written(t, masks.select(F.concat_ws("\t", "sequence", C("start0").cast("string"), C("end0").cast("string"))), "m.bed")


_ALL = _merged("SELECT sequence, start0, end0 FROM masks")


def _one_file(read: DataFrame) -> DataFrame:
    """Part files are files of their own to a reader; together they are one mask."""
    return intervals.merge(read)


@query("scan_bed_mask", _ALL)
def _(t: Tables) -> DataFrame:
    return _one_file(readers.bed(t.spark, _bed(t, t.masks)))


@query("write_mask_bed", _ALL)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "mask")
    sinks.mask_bed(intervals.merge(t.masks), path)
    return _one_file(readers.bed(t.spark, path))


_SEQ = "SELECT sequence, bases FROM sequences"


@query("scan_fasta", _SEQ)
def _(t: Tables) -> DataFrame:
    lines = t.sequences.select(F.concat(F.lit(">"), "sequence", F.lit(" note\n"), "bases"))
    return readers.sequences(t.spark, _written(t, lines, "fasta")).select("sequence", "bases")


@query("write_alignment_fasta", _SEQ)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "alignment")
    sinks.alignment_fasta(t.sequences.select(C("sequence").alias("record_id"), C("bases").alias("alignment")), path)
    return readers.sequences(t.spark, path).select("sequence", "bases")


@query("split_fasta", _SEQ)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "split")
    sinks.split_fasta(t.sequences, path)
    return readers.sequences(t.spark, path + "/*").select("sequence", "bases")


@query("convert_sequence_format", _SEQ)
def _(t: Tables) -> DataFrame:
    """GenBank text of each sequence, parsed again in the tasks."""
    from triloom.session import ship

    ship(t.spark)

    def run(batches):
        import pandas as pd

        from triloom.sources import formats

        for b in batches:
            rows = [r for name, bases in zip(b["sequence"], b["bases"], strict=True) for r in formats.genbank(formats.to_genbank([(name, bases)]))]
            yield pd.DataFrame(rows, columns=["sequence", "bases"])

    return t.sequences.select("sequence", "bases").mapInPandas(run, "sequence string, bases string")


_NUMBER = "SELECT sample_id, CAST('0x' || substring(hash, 1, 12) AS BIGINT) AS hash FROM sketch"


@query("scan_kmer_sig", "SELECT CAST(sample_id AS VARCHAR) AS sample, 31 AS ksize, hash, 1 AS abundance FROM (" + _NUMBER + ") GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    n = F.conv(F.substring("hash", 1, 12), 16, 10).cast("long")
    s = t.sketch.groupBy("sample_id").agg(F.sort_array(F.collect_set(n)).alias("mins"))
    sig = F.to_json(F.struct(C("sample_id").cast("string").alias("name"), F.array(F.struct(F.lit(31).alias("ksize"), "mins")).alias("signatures")))
    whole = s.groupBy(F.floor(C("sample_id") / 500).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(sig), ","), F.lit("]")).alias("v"))
    path = shared_folder(t.spark, "sig")
    whole.select("k", "v").write.partitionBy("k").text(path)
    return readers.signatures(t.spark, path + "/*").select("sample", "ksize", "hash", "abundance")


@query("write_query_tsv", 'SELECT feature, CAST(count AS VARCHAR) AS count, \'-\' AS nothing FROM (SELECT spdi AS feature, count(*) AS count FROM calls WHERE insertion <> \'?\' GROUP BY 1)')
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "tsv")
    sinks.query_tsv(q(t).features_summary().select("feature", "count", F.lit(None).cast("double").alias("nothing")), path)
    return t.spark.read.csv(path, sep="\t", header=True)


@query("read_genome_list", "SELECT '/g/' || c_name || '.fa' AS path FROM customer")
def _(t: Tables) -> DataFrame:
    lines = t.raw("customer").select(F.explode(F.array(F.concat(F.lit("/g/"), "c_name", F.lit(".fa")), F.lit("  "))))
    return readers.genome_list(t.spark, _written(t, lines, "list"))


#: A third of the customers have a pair of files of reads, a third an assembly, a third single reads.
_PAIRED = """SELECT sample, CASE WHEN k = 1 THEN '/in/' || n || '.fa.gz' END AS assembly, CASE WHEN k = 0 THEN '/in/' || n || '_R1.fastq' WHEN k = 2 THEN '/in/' || n || '_1.fq' END AS reads1, CASE WHEN k = 0 THEN '/in/' || n || '_R2.fastq' END AS reads2
FROM (SELECT CASE WHEN c_custkey % 3 = 2 THEN c_name || '_1' ELSE c_name END AS sample, c_custkey % 3 AS k, c_name AS n FROM customer)"""


def _files(t: Tables) -> DataFrame:
    k = C("sample_id") % 3
    ends = F.when(k == 0, F.array(F.lit("_R1.fastq"), F.lit("_R2.fastq"))).when(k == 1, F.array(F.lit(".fa.gz"))).otherwise(F.array(F.lit("_1.fq")))
    return t.samples.select("sample_name", F.explode(ends).alias("end")).select(F.concat(F.lit("/in/"), "sample_name", "end").alias("path"))


@query("pair_reads", _PAIRED)
def _(t: Tables) -> DataFrame:
    return readers.paired_files(_files(t))


@query("write_samples_tsv", _PAIRED)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "sheet")
    sinks.samples_table(readers.paired_files(_files(t)), path)
    sheet = readers.sample_sheet(t.spark, path)
    return sheet.select(C("Sample").alias("sample"), C("Assemblies").alias("assembly"), C("Reads1").alias("reads1"), C("Reads2").alias("reads2"))


_ENDS = ["bed", "bed.gz", "fa.xz", "fasta"]


@query("mask_source_dispatch", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'bed' ELSE 'sequence' END AS source FROM events")
def _(t: Tables) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(e) for e in _ENDS]), (C("event_id") % 4 + 1).cast("int"))
    return t.raw("events").select("event_id", readers.mask_kind(F.concat_ws(".", F.concat(F.lit("/masks/"), "event_type"), end)).alias("source"))


@query("scan_constellation_json", "SELECT 'L' || s_suppkey AS label, CAST(2 AS INTEGER) AS sites, CAST(1 + s_nationkey % 2 AS INTEGER) AS min_alt, CAST(s_nationkey % 3 AS INTEGER) AS max_ref, 'NC:' || (s_suppkey + 1) || ':A:C' AS first FROM supplier")
def _(t: Tables) -> DataFrame:
    """A definition for each supplier, a thousand in a file at most."""
    n = C("s_suppkey")
    own = t.raw("supplier").select(F.concat(F.lit("nuc:A"), (n + 1).cast("string"), F.lit("C")).alias("site"), (1 + C("s_nationkey") % 2).alias("min_alt"), (C("s_nationkey") % 3).alias("max_ref"), F.concat(F.lit("L"), n.cast("string")).alias("label"))
    sites = own.select("site").union(t.spark.createDataFrame([("s:HV69-",)], "site string"))
    to_id = {r["site"]: r["id"] for r in sites.select("site", ids.constellation_id(C("site"), "NC", F.lit("ACGTACGT")).alias("id")).collect()}
    text = F.to_json(F.struct(F.array("site", F.lit("s:HV69-")).alias("sites"), F.struct("min_alt", "max_ref").alias("rules"), F.array().cast("array<string>").alias("tags"), "label"))
    path = shared_folder(t.spark, "json")
    own.select(text).write.option("maxRecordsPerFile", 1000).text(path)
    d = readers.constellations(t.spark, path, to_id.get)
    return t.spark.createDataFrame([(k, len(x.sites), x.needed, x.max_ref, x.sites[0]) for k, x in d.items()], "label string, sites int, min_alt int, max_ref int, first string")


@query(
    "scan_snippy_dir",
    """SELECT DISTINCT CASE WHEN sequence < 'chr3' THEN 'S1' ELSE 'S2' END AS sample, sequence AS chrom, position AS pos, insertion AS alt FROM variants
UNION ALL SELECT CASE WHEN sequence < 'chr3' THEN 'S1' ELSE 'S2' END, sequence, CAST(p AS INTEGER), 'N' FROM (SELECT sequence, unnest([1, 2]) AS p FROM sequences) s
WHERE NOT EXISTS (SELECT 1 FROM variants v WHERE v.sequence = s.sequence AND s.p BETWEEN v.position AND v.position + v.deletion - 1)""",
)
def _(t: Tables) -> DataFrame:
    """Two sample folders with their variants and aligned sequences: the variants, and the masked positions."""
    root = shared_folder(t.spark, "snippy")
    v = written(_with_ref(t), "variants")
    for name, part in (("S1", "sequence < 'chr3'"), ("S2", "sequence >= 'chr3'")):
        line = F.concat_ws("\t", "sequence", C("position").cast("string"), F.lit("."), "ref", "insertion", F.lit("."), F.lit("."), F.concat(F.lit("TYPE="), C("var_type")))
        v.where(part).select(line).write.text(f"{root}/{name}/snps.vcf")
        t.sequences.where(part).select(F.concat(F.lit(">"), "sequence", F.lit("\n"), F.repeat(F.lit("N"), 2), "bases")).write.text(f"{root}/{name}/snps.aligned.fa")
    found, gone = readers.snippy_dirs(t.spark, root)
    masked = intervals.positions(gone, 1).select("sample", C("sequence").alias("chrom"), C("position").cast("int").alias("pos"), F.lit("N").alias("alt"))
    return found.select("sample", "chrom", "pos", "alt").distinct().union(masked)


# The warehouse.


def _index(t: Tables) -> SampleIndex:
    index = SampleIndex(t.spark, shared_folder(t.spark, "project"))
    for name in ("genome", "plasmid"):
        index.add_reference(name, t.sequences.join(t.references.where(C("reference_name") == name), "sequence").select("sequence", "bases"))
    return index


@query("add_reference_genome", "SELECT reference_name, sequence, length FROM sequences JOIN refs USING (sequence)")
def _(t: Tables) -> DataFrame:
    index = _index(t)
    return index.references.join(index.sequences, "sequence").select("reference_name", "sequence", "length")


_NODES = "SELECT n_name AS name, CAST(r_regionkey + 2 + n_nationkey % 7 AS DOUBLE) AS root_dist, true AS is_leaf FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT r_name, CAST(r_regionkey + 1 AS DOUBLE), false FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'root', 0.0, false"


def _shown(t: Tables, root: tree.Node) -> DataFrame:
    return tree.tree_nodes(t.spark, root).select("name", "root_dist", "is_leaf")


def _on_tree(t: Tables):
    """An index with the nations as samples and their tree as that of its reference; the query on it."""
    index = SampleIndex(t.spark, shared_folder(t.spark, "project"))
    index.add_reference("genome", t.spark.createDataFrame([("chr0", "ACGT")], "sequence string, bases string"))
    index.add_variants(t.raw("nation").select(C("n_name").alias("sample"), F.lit("chr0").alias("chrom"), F.lit(1).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.lit("SNP").alias("type")))
    index.update_tree("genome", tree.to_newick(_newick(t)), 10)
    return index.samples_query("mutations", "genome")


@query("update_tree", _NODES)
def _(t: Tables) -> DataFrame:
    index = SampleIndex(t.spark, shared_folder(t.spark, "project"))
    index.update_tree("genome", "(a,b);", 1)
    index.update_tree("other", "(c,d);", 1)
    index.update_tree("genome", tree.to_newick(_newick(t)), 10)
    return _shown(t, tree.parse_newick(index.stored_tree("genome")[0]))


@query("reference_tree", _NODES)
def _(t: Tables) -> DataFrame:
    """The stored tree of a reference comes with the query on it, and its leaves are the samples."""
    return _on_tree(t).nodes.select("name", "root_dist", "is_leaf")


@query("write_tree_newick", _NODES)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "newick")
    sinks.newick_file(t.spark, tree.to_newick(_newick(t)), path)
    return _shown(t, tree.parse_newick(t.spark.read.text(path).first()[0]))


for _name in ("db_size", "storage_size"):

    @query(_name, "SELECT * FROM (VALUES ('reference_sequences', true), ('Total', true)) t(part, filled)")
    def _(t: Tables) -> DataFrame:
        """Sizes depend on the writer, so only that there are some is told."""
        return _index(t).sizes("KB").select("part", ((C("size") > 0) & (C("files") > 0)).alias("filled"))


# Other names of what is registered already.


@query("set_len", "SELECT count(*) AS n FROM metadata WHERE balance > 0")
def _(t: Tables) -> DataFrame:
    return SampleSet.of(t.metadata.where("balance > 0")).size()


@query("set_is_empty", "SELECT count(*) = 0 AS is_empty FROM metadata WHERE balance > 1e9")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(SampleSet.of(t.metadata.where("balance > 1e9")).is_empty(),)], "is_empty boolean")


@query("is_empty", "SELECT count(*) FILTER (status >= 1) = 0 AS is_empty FROM h1", **H1)
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(h(t, 1).is_empty(include_unknown=True),)], "is_empty boolean")


@query("toset", "SELECT sample_name FROM h1 JOIN samples USING (sample_id) WHERE status = 1", **H1)
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(n,) for n in h(t, 1).select_unknown().toset()], "sample_name string")


@query("str", "SELECT '<SamplesQuery[selected=' || round_even(100.0 * p / n, 0)::INT || '% (' || p || '/' || n || ') samples, unknown=' || round_even(100.0 * u / n, 0)::INT || '% (' || u || '/' || n || ') samples]>' AS text FROM (SELECT count(*) FILTER (status = 2) AS p, count(*) FILTER (status = 1) AS u, count(*) AS n FROM h1)", **H1)
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(str(h(t, 1)),)], "text string")


@query("which_exists", "SELECT sample_name FROM samples JOIN customer ON c_custkey = sample_id WHERE c_nationkey = 2")
def _(t: Tables) -> DataFrame:
    asked = t.raw("customer").where("c_nationkey = 2").select(C("c_name").alias("sample_name")).union(t.spark.createDataFrame([("nobody",)], "sample_name string"))
    return t.samples_named(asked).select("sample_name")


@query("has_kmer_index", "SELECT DISTINCT sample_id FROM sketch")
def _(t: Tables) -> DataFrame:
    return t.with_kmer_index()


@query("restore_name", "SELECT DISTINCT p_partkey, p_name FROM part")
def _(t: Tables) -> DataFrame:
    p = t.raw("part").select("p_partkey", "p_name")
    return restore_names(p.select("p_partkey", ids.sanitize_name(C("p_name")).alias("safe")), "safe", p, "p_name").select("p_partkey", "p_name").distinct()


@query("union_all", _ALL)
def _(t: Tables) -> DataFrame:
    m = t.masks
    return intervals.union_all([m.where("start0 % 3 = 0"), m.where("start0 % 3 = 1"), m.where("start0 % 3 = 2")])


_STYLE = "SELECT sample_name AS leaf, 'first' AS \"column\", CASE status WHEN 2 THEN 'Present' WHEN 1 THEN 'Unknown' ELSE 'Absent' END AS status, CASE status WHEN 2 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS color FROM h1 JOIN samples USING (sample_id)"


@query("highlight_theme", _STYLE, **H1)
def _(t: Tables) -> DataFrame:
    return q(t).join_nodes(t.tree).tree_annotations({"first": h(t, 1)}, ("red", "yellow", "green"))


@query("render_tree_image", "SELECT 'text' AS what, count(*) AS n FROM nation UNION ALL SELECT 'rect', count(*) FROM nation UNION ALL SELECT 'lines', count(*) FROM (SELECT n_name FROM nation UNION ALL SELECT DISTINCT r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'root')")
def _(t: Tables) -> DataFrame:
    """The drawn picture: a label and a square for each leaf; and the plain one: a line a node."""
    q_ = _on_tree(t)
    marks = [tuple(r) for r in q_.tree_annotations({"all": q_}).collect()]
    svg = sinks.svg_tree(q_.root, marks)
    return t.spark.createDataFrame([("text", svg.count("<text ")), ("rect", svg.count("<rect ")), ("lines", len(sinks.ascii_tree(q_.root).splitlines()))], "what string, n long")


@query("scan_genbank", _SEQ)
def _(t: Tables) -> DataFrame:
    from triloom.sources import formats

    rows = [(r["sequence"], r["bases"]) for r in t.sequences.select("sequence", "bases").collect()]  # five sequences
    path = shared_folder(t.spark, "genbank") + "/x.gbk"
    write_text(t.spark, path, formats.to_genbank(rows))
    return readers.sequences(t.spark, path).select("sequence", "bases")


#: Files that a task writes, of those with a row each.
_FILES_A_TASK = 250


def _file_each(t: Tables, texts: DataFrame, root: str, name: str) -> DataFrame:
    """(sample, path): texts (value) as files of one folder, one each, which tasks write side by side. The sample
    is what the pattern `name` finds in the text."""
    tasks = -(-texts.count() // _FILES_A_TASK)
    # With the second algorithm tasks move their own files at their end, not the driver all of them.
    texts.repartition(max(tasks, 1)).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(root)
    return t.spark.read.text(root, wholetext=True).select(F.regexp_extract("value", name, 1).alias("sample"), F.input_file_name().alias("path"))


@query("scan_vcf_kmer_fofn", "SELECT 'S' || s_suppkey AS sample, 'chr0' AS sequence, CAST(2 + s_nationkey AS INTEGER) AS position, 'C' AS insertion, CAST(2 AS INTEGER) AS hashes FROM supplier")
def _(t: Tables) -> DataFrame:
    """A sheet of variants and sketches, a pair of files for each supplier, loaded in one go."""
    from triloom import loading

    root = shared_folder(t.spark, "sheet")
    own, name = t.raw("supplier").select("s_suppkey", "s_nationkey"), F.concat(F.lit("S"), "s_suppkey")
    lines = F.concat(F.lit("##fileformat=VCFv4.2\n##sample="), name, F.lit("\nchr0\t"), (2 + C("s_nationkey")).cast("string"), F.lit("\t.\tA\tC\t.\t.\tTYPE=SNP"))
    mins = F.array(F.lit(5).cast("long"), (100 + C("s_suppkey")).cast("long"))
    sketch = F.to_json(F.array(F.struct(F.lit("other").alias("name"), name.alias("filename"), F.array(F.struct(F.lit(31).alias("ksize"), mins.alias("mins"))).alias("signatures"))))
    vcf = _file_each(t, own.select(lines.alias("value")), f"{root}/vcf", "##sample=(.*)").withColumnRenamed("path", "VCF")
    sig = _file_each(t, own.select(sketch.alias("value")), f"{root}/sig", '"filename":"([^"]*)"').withColumnRenamed("path", "Sketch File")
    vcf.join(sig, "sample").select(C("sample").alias("Sample"), "VCF", F.lit("NA").alias("Mask File"), "Sketch File").write.csv(f"{root}/fofn.tsv", header=True, sep="\t")
    index = SampleIndex(t.spark, shared_folder(t.spark, "project"))
    sheet = readers.vcf_fofn(t.spark, f"{root}/fofn.tsv").collect()
    loading.load_vcfs(index, [(r["Sample"], r["VCF"], r["Mask File"]) for r in sheet])
    loading.load_signatures(index, [(r["Sample"], r["Sketch File"]) for r in sheet], [31])
    n = index.sketch.groupBy("sample_id").agg(F.count("*").cast("int").alias("hashes"))
    return index.calls.join(index.samples, "sample_id").join(n, "sample_id").select(C("sample_name").alias("sample"), "sequence", "position", "insertion", "hashes")


@query("skip_missing_files", "SELECT s_name AS sample, s_suppkey % 9 < 7 AS kept FROM supplier")
def _(t: Tables) -> DataFrame:
    """A folder for each residue modulo 7, and a sheet that asks for residues modulo 9."""
    root = shared_folder(t.spark, "reads")
    t.spark.range(7).join(t.raw("supplier"), C("s_suppkey") % 7 == C("id"), "left").select("id", F.coalesce("s_name", F.lit("-")).alias("v")).write.partitionBy("id").text(root)
    sheet = [(r["s_name"], f"{root}/id={r['s_suppkey'] % 9}") for r in t.raw("supplier").select("s_name", "s_suppkey").collect()]
    kept, gone = readers.existing_files(t.spark, sheet)
    return t.spark.createDataFrame([(r[0], True) for r in kept] + [(s, False) for s in gone], "sample string, kept boolean")


@query("write_kmer_sig", "SELECT CAST(sample_id AS VARCHAR) AS sample, 31 AS ksize, hash FROM (" + _NUMBER + ") GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    n = F.conv(F.substring("hash", 1, 12), 16, 10).cast("long")
    path = shared_folder(t.spark, "sigs")
    sinks.signatures(t.sketch.select(C("sample_id").cast("string").alias("sample"), F.lit(31).alias("ksize"), n.alias("hash")).distinct(), path)
    return readers.signatures(t.spark, path).select("sample", "ksize", "hash")
