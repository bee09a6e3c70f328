"""End to end on files: readers, ingest, fluent queries, sinks, stream and command line."""

import gzip
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triloom import cli
from triloom.functions import ids
from triloom.index import ExistsError, SampleIndex, init_project, new_samples, open_project
from triloom.operators import align, lookup, typing
from triloom.operators.bitmaps import described, from_bitmaps, sizes, to_bitmaps, union_bitmaps
from triloom.query import SamplesQuery
from triloom.sources import formats, readers, sinks
from triloom.streaming.ingest import stream_variants

HEAD = '##fileformat=VCFv4.2\n##INFO=<ID=ANN,Number=.,Type=String,Description="Functional annotations: \'Allele | Annotation | Annotation_Impact | Gene_Name | Gene_ID | HGVS.c | HGVS.p | cDNA.pos / cDNA.length\'">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n'
VCF = {
    "A": ["ref\t3\t.\tG\tT\t.\t.\tTYPE=SNP;ANN=T|synonymous_variant|LOW|geneX|X1|c.3G>T||1/9,T|missense_variant|MODERATE|geneX|X1|c.3G>T|p.Lys1Asn|3/9", "ref\t7\t.\tGT\tG\t.\t.\tTYPE=del"],
    "B": ["ref\t3\t.\tG\tT,C\t.\t.\tDP=1", "ref\t5\t.\tA\tC\t.\t.\tDP=2"],
    "C": ["ref\t5\t.\tA\tC\t.\t.\tDP=2"],
}
REF = "ACGTACGTACGT"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    for s, rows in VCF.items():
        (d / f"{s}.vcf").write_text(HEAD + "".join(r + "\n" for r in rows))
    (d / "C.bed").write_text("ref\t2\t4\nref\t4\t4\n")
    (d / "ref.fasta.gz").write_bytes(gzip.compress(f">ref text\n{REF[:6]}\n{REF[6:]}\n".encode()))
    (d / "fofn.tsv").write_text("Sample\tVCF\tMask File\n" + "".join(f"{s}\t{d}/{s}.vcf\t{f'{d}/C.bed' if s == 'C' else 'NA'}\n" for s in VCF))
    (d / "mlst.tsv").write_text("x/A.fa\tecoli\t1\tadk(1)\tbgl(2)\nx/B.fa\tecoli\t-\tadk(1)\tbgl(51+)\n")
    return d


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    return str(tmp_path_factory.mktemp("project"))


@pytest.fixture(scope="module")
def index(spark, files, project):
    root = project
    assert cli.main(["--project", root, "init"], spark) == 0
    cli.main(["--project", root, "load", "vcf", str(files / "fofn.tsv"), "--reference-file", str(files / "ref.fasta.gz"), "--reference-name", "genome"], spark)
    cli.main(["--project", root, "load", "mlst-tseemann", str(files / "mlst.tsv")], spark)
    return open_project(spark, root)


def test_vcf_and_best_annotation(spark, files):
    names = readers.ann_names(spark, str(files / "A.vcf"))
    assert names[0] == "Allele" and names[-1] == "cDNA.pos / cDNA.length"
    rows = {r["variant_id"]: r for r in readers.vcf_with_annotations(spark, str(files / "A.vcf"), names).collect()}
    assert rows["ref:3:1:T"]["annotation"] == "missense_variant" and rows["ref:3:1:T"]["sample"] == "A"
    assert rows["ref:7:2:G"]["annotation"] is None and rows["ref:7:2:G"]["type"] == "INDEL"
    assert {r["alt"] for r in readers.vcf(spark, str(files / "B.vcf")).collect()} == {"T", "C"}


def test_hasa_with_unknown_and_conflict(index):
    q = SamplesQuery.all(index)
    r = q.hasa("ref:3:G:T")
    assert r.toset() == {"A", "B"} and r.toset(include_present=False, include_unknown=True) == {"C"}
    assert r.reset_universe().state.count() == 3
    assert str(r) == "<SamplesQuery[selected=67% (2/3) samples, unknown=33% (1/3) samples]>"
    assert (~r).toset(include_unknown=True) == {"C"}
    assert q.hasa(["ref:3:G:T", "ref:5:A:C"]).toset() == {"B"}
    assert q.hasa(["ref:3:G:T", "ref:5:A:C"]).toset(include_present=False, include_unknown=True) == {"C"}
    assert q.hasa("hgvs:ref:X1:p.Lys1Asn").toset() == {"A", "B"} == q.hasa("hgvs_gn:ref:geneX:p.Lys1Asn").toset()
    assert q.hasa("mlst:ecoli:adk:1").toset() == {"A", "B"}
    assert q.hasa("mlst:ecoli:bgl:2").toset(include_present=False, include_unknown=True) == {"B"}
    assert q.hasa("ref:9:1:A").is_empty()
    assert (q.hasa("ref:3:G:T") | q.hasa("ref:5:A:C")).toset() == {"A", "B", "C"}


def test_summaries(index):
    q = SamplesQuery.all(index)
    s = {r["feature"]: r for r in q.features_summary(include_unknown_samples=True).collect()}
    assert (s["ref:3:1:T"]["count"], s["ref:3:1:T"]["unknown_count"], s["ref:3:1:T"]["total"]) == (2, 1, 3)
    assert s["ref:3:1:T"]["percent"] == pytest.approx(200 / 3)
    only = q.isa("A").features_summary(selection="unique")
    assert [r["feature"] for r in only.collect()] == ["ref:7:2:G"]
    assert q.tofeaturesset("mlst") == {"mlst:ecoli:adk:1", "mlst:ecoli:bgl:2"}
    c = {r["feature"]: r for r in q.features_comparison({"x": q.isa(["A", "B"]), "none": q.isa("Z")}, unit="proportion").collect()}
    assert c["ref:3:1:T"]["x_proportion"] == 1 and c["ref:3:1:T"]["none_proportion"] is None and c["ref:3:1:T"]["none_total"] == 0


def test_index_level_lookups(spark, index):
    assert index.sample_names()[:3] == ["A", "B", "C"] and index.reference_names() == ["genome"] and index.mlst_schemes() == ["ecoli"]
    assert (index.count_samples(), index.count_references()) == (3, 1)
    assert (index.count_mutations("genome"), index.count_mutations("genome", include_unknown=True)) == (3, 5)
    top = {r["feature"]: (r["count"], r["total"]) for r in index.features_summary("mutations", "genome").collect()}
    assert top == {"ref:3:1:T": (2, 3), "ref:5:1:C": (2, 3), "ref:7:2:G": (1, 3)}
    alleles = {r["feature"]: (r["count"], r["total"]) for r in index.features_summary("mlst", "ecoli").collect()}
    assert alleles == {"mlst:ecoli:adk:1": (2, 2), "mlst:ecoli:bgl:2": (1, 2)}
    with pytest.raises(ValueError):
        index.features_summary("other")
    assert index.sample_ids(["A", "Z"], ignore_missing=True).count() == 1
    with pytest.raises(ValueError, match="Z"):
        index.sample_ids(["A", "Z"])
    assert index.count_samples_by_features(["ref:3:G:T", "mlst:ecoli:adk:9"]) == {"ref:3:G:T": 2, "mlst:ecoli:adk:9": 0}
    assert index.spdi_with_bases(["ref:7:2:G"]) == {"ref:7:2:G": "ref:7:GT:G"} and not index.has_kmer_index("A")
    frame = spark.createDataFrame([("A",)], "who string")
    assert index.samples_query("dataframe", data_frame=frame, sample_names_column="who").toset() == {"A"}


def test_kmer_queries(spark, tmp_path):
    own = SampleIndex(spark, str(tmp_path / "own"))
    sets = {"A": range(10), "B": range(5, 15), "C": range(100, 110)}
    rows = [(n, k, h) for n, hs in sets.items() for h in hs for k in (21, 31)]
    own.add_sketches(spark.createDataFrame(rows, "sample string, ksize int, hash long"))
    own.add_sketches(spark.createDataFrame([("A", 31, 77)], "sample string, ksize int, hash long"))  # has one, is skipped
    q = own.samples_query()
    assert q.within("A", distance=0.67, units="kmer_jaccard").toset() == {"A", "B"} and own.has_kmer_index("A")
    ids_, m = q.to_distances()
    assert m[0, 1] == pytest.approx(2 / 3) and m[0, 2] == 1 and len(ids_) == 3
    t = q.build_tree("kmer")
    assert t.isin(["A", "B"], kind="mrca").toset() == {"A", "B"}
    with pytest.raises(ValueError):
        q.to_distances(kmer_size=51)


def test_metadata(spark, index):
    m = spark.createDataFrame([("A", "red"), ("B", "blue"), ("Z", "red")], "who string, color string")
    q = SamplesQuery.all(index).join(m, sample_names_column="who")
    assert q.state.count() == 2
    assert q.isa("red", kind="dataframe", column="color").toset() == {"A"}
    assert q.isa("^b", kind="dataframe", column="color", regex=True).toset() == {"B"}
    assert q.isin(F.col("color") != "red", kind="dataframe").toset() == {"B"}
    with pytest.raises(ValueError):
        q.join(m, sample_names_column="who")
    assert set(q.toframe().columns) >= {"Query", "Sample Name", "Sample ID", "Status", "color"}


def test_tree_queries(index):
    q = SamplesQuery.all(index).join_tree("(genome:0,A:2,(B:1,C:1):1);", 10, "genome")
    assert q.isin("B", kind="distance", distance=20, units="substitutions").toset() == {"B", "C"}
    assert q.isin(["B", "C"], kind="mrca").toset() == {"B", "C"}
    assert q.isa("A").prune().leaf_names() == ["genome", "A"]
    rows = q.tree_annotations({"x": SamplesQuery.all(index).hasa("ref:3:G:T")}).collect()
    assert {(r["leaf"], r["status"]) for r in rows} == {("A", "Present"), ("B", "Present"), ("C", "Unknown")}


def test_alignments(spark, index):
    s, r = index.samples, index.sequences.select("sequence", "bases")
    a = {x["record_id"]: x["alignment"] for x in align.core_alignment(index.calls, s, r, None, "genome").collect()}
    assert a == {"genome": "GA", "A": "TA", "B": "TC", "C": "GC"}
    f = {x["record_id"]: x["alignment"] for x in align.full_alignment(index.calls, s, r, index.masks).collect()}
    assert f == {"A": "ACTTACG-ACGT", "B": "ACTTCCGTACGT", "C": "ACNNCCGTACGT"}
    assert SamplesQuery.on_reference(index, "genome").build_tree("mutation").toset() == {"A", "B", "C"}


def test_guards(spark, index, files):
    with pytest.raises(ExistsError):
        index.add_variants(readers.vcf(spark, str(files / "A.vcf")))
    with pytest.raises(ExistsError):
        index.add_reference("genome", spark.createDataFrame([("x", "A")], "sequence string, bases string"))
    with pytest.raises(ValueError):
        index.update_tree("genome", "(A,B);", 0)
    n = index.calls.count()
    index.add_variants(readers.vcf(spark, str(files / "A.vcf")), allow_existing=True)
    assert index.calls.count() == n
    index.update_tree("genome", "(A:1,B:1);", 12)
    assert SamplesQuery.on_reference(index, "genome").toset() == {"A", "B"}


def test_stream(spark, index, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.tsv").write_text("D\tref\t5\tA\tC\n")
    for _ in range(2):  # a second run finds nothing new
        stream_variants(spark, str(tmp_path / "in"), index, str(tmp_path / "state")).awaitTermination()
    assert SamplesQuery.all(index).hasa("ref:5:A:C").toset() >= {"B", "D"}


def test_command_line(spark, index, project, tmp_path, capsys):
    p = ["--project", project]
    cli.main([*p, "list", "genomes"], spark)
    cli.main([*p, "query", "hasa:ref:3:G:T", "--summary"], spark)
    cli.main([*p, "query", "hasa:ref:3:G:T", "--features-summary", "mutations"], spark)
    cli.main([*p, "db", "size"], spark)
    cli.main([*p, "build", "alignment", "--reference-name", "genome"], spark)
    out = capsys.readouterr().out
    assert "genome" in out and "ref:3:1:T" in out and "Total" in out and ">A" in out
    sinks.query_tsv(SamplesQuery.all(index).summary(), str(tmp_path / "q"))
    assert "percent_present" in "".join(f.read_text() for f in (tmp_path / "q").glob("part*"))


def test_formats(spark, tmp_path):
    rows = [("s1", "ACGT" * 30), ("s2", "TTTT")]
    (tmp_path / "x.gbk").write_text(formats.to_genbank(rows))
    (tmp_path / "y.fa").write_text(formats.to_fasta(rows))
    for name in ("x.gbk", "y.fa"):
        assert sorted((r["sequence"], r["bases"]) for r in readers.sequences(spark, str(tmp_path / name)).collect()) == rows
    (tmp_path / "a.sig").write_text(json.dumps([{"name": "A", "signatures": [{"ksize": 31, "mins": [1, 2**64 - 1]}]}]))
    assert sorted((r["sample"], r["hash"]) for r in readers.signatures(spark, str(tmp_path / "a.sig")).collect()) == [("A", -1), ("A", 1)]
    with pytest.raises(ValueError):
        readers.mask_source("x.txt")
    assert readers.mask_source("a.bed.gz") == "bed" and readers.mask_source("a.fa.xz") == "sequence"
    sinks.split_fasta(readers.sequences(spark, str(tmp_path / "y.fa")), str(tmp_path / "split"))
    assert sorted(p.name for p in (tmp_path / "split").glob("record=*")) == ["record=s1", "record=s2"]


def test_pairing(spark):
    for files in (["x/a_1.fq.gz", "x/a_2.fq.gz", "b.fa", "c_R1.fastq", "c_R2.fastq", "d.fq", "e_f.fq.xz", "e_r.fq.xz", "g_1_x.fq", "g_2_x.fq", "h_1.fq", "i_2.fq", "k.gbk.gz"], ["a_1_1.fq", "a_1_2.fq"], []):
        table = readers.paired_files(spark.createDataFrame([(f,) for f in files], "path string"))
        assert sorted(map(tuple, table.collect())) == sorted(readers.pair_reads(files))
    with pytest.raises(Exception, match="several inputs"):
        readers.paired_files(spark.createDataFrame([("a.fa",), ("a.fq",)], "path string")).collect()
    assert readers.pair_reads(["a_1.fq.gz", "a_2.fq.gz", "b.fa", "c_R1.fastq", "c_R2.fastq", "d.fq"]) == [
        ("a", None, "a_1.fq.gz", "a_2.fq.gz"),
        ("b", "b.fa", None, None),
        ("c", None, "c_R1.fastq", "c_R2.fastq"),
        ("d", None, "d.fq", None),
    ]


def test_repeated_sample_in_fofn(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("Sample\tVCF\tMask File\nA\tx\t\nA\ty\tNA\n")
    with pytest.raises(ValueError):
        readers.vcf_fofn(spark, str(tmp_path / "f.tsv"))


def test_bitmaps(spark):
    pairs = spark.createDataFrame([("f", i) for i in (0, 1, 7, 32767, 32768, 100000)] + [("g", 5)], "feature string, sample_id long")
    m = to_bitmaps(pairs)
    assert sorted(map(tuple, from_bitmaps(union_bitmaps(m.union(m))).collect())) == sorted(map(tuple, pairs.collect()))
    assert {r["feature"]: r["n"] for r in sizes(m).collect()} == {"f": 6, "g": 1}
    assert sorted(map(tuple, described(m).collect())) == [("f", 6, 0, 100000, 165543), ("g", 1, 5, 5, 5)]
    assert from_bitmaps(to_bitmaps(pairs.limit(0))).isEmpty() and sizes(union_bitmaps(m.limit(0))).isEmpty()


def test_bitmaps_of_random_sets(spark):
    r = random.Random(3)
    rows = [(f"f{k}", i) for k, most in enumerate((1, 70_000, 40)) for i in r.sample(range(most + 100_000), 20 + k * 2000)]
    df = spark.createDataFrame(rows + rows[:50], "feature string, sample_id long").repartition(3)
    assert sorted(map(tuple, from_bitmaps(to_bitmaps(df)).collect())) == sorted(rows)
    halves = [to_bitmaps(df.where(f"sample_id % 3 {how} 0")) for how in ("=", "<>")]
    assert sorted(map(tuple, sizes(union_bitmaps(*halves)).collect())) == sorted(Counter(f for f, _ in rows).items())


def test_stored_sets_follow_the_loads(spark, tmp_path):
    def vcf(rows):
        return spark.createDataFrame([(s, "ref", p, "A", alt, "SNP") for s, p, alt in rows], "sample string, chrom string, pos int, ref string, alt string, type string")

    plain, stored = SampleIndex(spark, str(tmp_path / "plain")), SampleIndex(spark, str(tmp_path / "stored"))
    masks = spark.createDataFrame([("c", "ref", 4, 6)], "sample string, sequence string, start0 int, end0 int")
    for index in (plain, stored):
        index.add_reference("genome", spark.createDataFrame([("ref", "ACGT" * 20)], "sequence string, bases string"))
        index.add_variants(vcf([("a", 3, "T"), ("b", 3, "T"), ("b", 9, "C")]))
        if index is stored:
            assert not index.has_sets
            index.build_sets()
        index.add_variants(vcf([("c", 3, "T"), ("c", 5, "G"), ("a", 3, "T")]), masks, allow_existing=True)
        index.add_variants(vcf([("d", 70_000, "T")]))

    def told(index):
        asked = ["ref:3:A:T", "ref:3:1:T", "ref:70000:1:T", "ref:8:1:T"]
        tables = [index.mutation_counts(), index.mutation_counts("genome", True), index.mutation_counts("other"), index.reference_mutations(), index.totals(), index.samples_of_features(index._asked(asked)), index.feature_sample_counts(index._asked(asked))]
        return [sorted(map(tuple, t.collect())) for t in tables], index.count_mutations("genome"), index.find_samples_by_features(asked)

    before = told(stored)
    assert before == told(plain) and ("ref:3:1:T", 3) in before[0][0] and ("ref:8:1:T", 0) in before[0][6]
    rows = stored.table("sample_sets").count()
    stored.compact("sample_sets")
    assert told(stored) == before and stored.table("sample_sets").count() < rows
    stored.build_sets()
    assert told(stored) == before


def test_counts_from_sets_read_no_calls(spark, tmp_path):
    index = SampleIndex(spark, str(tmp_path))
    index.add("calls", spark.createDataFrame([(1, "ref", 3, 1, "T", "SNP", "ref:3:1:T"), (1, "ref", 200_000, 1, "T", "SNP", "ref:200000:1:T")], "sample_id long, sequence string, position int, deletion int, insertion string, var_type string, spdi string"))
    index.build_sets()
    assert all("sample_sets" in f for f in index.mutation_counts().inputFiles())
    assert all("/calls/" not in f for f in index.variant_samples(index._variants_asked(index._asked(["ref:3:1:T"]))).inputFiles())


def test_typing(spark, index):
    text = json.dumps({"sites": ["nuc:G3T", "nuc:A5C"], "rules": {"min_alt": 1, "max_ref": 1, "nuc:G3T": "alt"}, "tags": ["t"], "label": "L"})
    d = typing.definitions([text, text.replace("nuc:G3T", "bad")], lambda s: {"nuc:G3T": "ref:3:G:T", "nuc:A5C": "ref:5:A:C"}.get(s))
    assert set(d) == {"t", "L"} and d["L"].needed == 1
    q = SamplesQuery.all(index).isa(["A", "B", "C"]).reset_universe()
    out = q.typed(d["L"]).state
    apart = typing.isa_type(q.state, typing.sites_of([q.feature_status(ids.parse_feature(f)) for f in d["L"].sites]), q.feature_sites(list(d["L"].must_have)), 1, 1)
    assert sorted(out.collect()) == sorted(apart.collect())
    named = {r["sample_name"]: r["status"] for r in out.join(index.samples, "sample_id").collect()}
    assert named["A"] == 2 and named["B"] == 2


def test_a_lookup_reads_the_folder_of_its_position_only(spark, tmp_path):
    own = SampleIndex(spark, str(tmp_path / "wide"))
    rows = [(f"s{i % 5}", f"chr{i % 3}", 1 + i * 1000, "A", "C", "SNP") for i in range(400)]
    own.add_variants(spark.createDataFrame(rows, "sample string, chrom string, pos int, ref string, alt string, type string"))
    found = own.samples_query().hasa("chr1:1001:1:C").state
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sequence" in plan and "(bin" in plan and "PushedFilters: [" in plan and "GreaterThanOrEqual(position,1001)" in plan
    scanned = own.calls.where(lookup.at(own.calls, "chr1", 1001, 1001))
    assert len(scanned.inputFiles()) > 1 and scanned.select(F.input_file_name()).distinct().count() == 1
    read = own.calls._jdf.queryExecution().toString()
    assert "Exchange" not in read and "Aggregate" not in read  # nothing is deduplicated on reading
    assert own.samples_query().hasa("chr1:1001:1:C").toset() == {"s1"}


def test_a_refused_load_leaves_nothing_behind(spark, tmp_path):
    own = SampleIndex(spark, str(tmp_path / "own"))
    v = lambda *names: spark.createDataFrame([(n, "c", 5, "A", "C", "SNP") for n in names], "sample string, chrom string, pos int, ref string, alt string, type string")
    own.add_variants(v("a"))
    with pytest.raises(ExistsError, match="variants"):
        own.add_variants(v("a", "b"))
    assert own.sample_names() == ["a"] and own.calls.count() == 1
    own.add_variants(v("a", "a", "b"), allow_existing=True)
    own.add_variants(v("a", "b"), allow_existing=True)
    assert own.sample_names() == ["a", "b"] and own.calls.count() == 2


def test_names_are_numbered_in_order_over_ranges(spark):
    samples = spark.createDataFrame([(4, "n0007")], "sample_id long, sample_name string")
    names = spark.createDataFrame([(f"n{i:04}",) for i in range(3000, -1, -1)] * 2, "sample_name string")
    got = sorted(tuple(r) for r in new_samples(samples, names).collect())
    want = [n for n in sorted({f"n{i:04}" for i in range(3001)}) if n != "n0007"]
    assert got == [(5 + i, n) for i, n in enumerate(want)]
    assert new_samples(samples, names.limit(0)).count() == 0


def test_masks_of_both_kinds_and_load_options(spark, tmp_path, capsys):
    d = tmp_path
    for s in ("A", "B", "E"):
        (d / f"{s}.vcf").write_text(HEAD + ("ref\t3\t.\tG\tT\t.\t.\tTYPE=SNP\n" if s != "E" else ""))
    (d / "A.fa").write_text(">ref\nACGTANNTACG-\n")
    (d / "B.bed").write_text("ref\t0\t2\n")
    (d / "ref.fa").write_text(f">ref\n{REF}\n")
    (d / "fofn.tsv").write_text(f"Sample\tVCF\tMask File\nA\t{d}/A.vcf\t{d}/A.fa\nB\t{d}/B.vcf\t{d}/B.bed\nE\t{d}/E.vcf\tNA\n")
    unknown = {}
    for name, more in (("with", []), ("without", ["--no-index-unknown"]), ("batches", ["--sample-batch-size", "1"])):
        root = str(d / name)
        cli.main(["--project", root, "init"], spark)
        cli.main(["--project", root, "load", "vcf", str(d / "fofn.tsv"), "--reference-file", str(d / "ref.fa"), *more], spark)
        i = open_project(spark, root)
        assert i.sample_names() == ["A", "B", "E"]  # a sample without variants is one too
        masks = sorted((r["sample_name"], r["start0"], r["end0"]) for r in i.masks.join(i.samples, "sample_id").collect())
        assert masks == [("A", 5, 7), ("A", 11, 12), ("B", 0, 2)]
        unknown[name] = sorted((r["sample_name"], r["position"]) for r in i.calls.where("insertion = '?'").join(i.samples, "sample_id").collect())
    assert unknown["with"] == unknown["batches"] == [("A", 6), ("A", 7), ("A", 12), ("B", 1), ("B", 2)] and unknown["without"] == []
    q = SamplesQuery.on_reference(open_project(spark, str(d / "with")), "ref")
    full = {r["record_id"]: r["alignment"] for r in q.alignment("ref").collect()}
    assert full["A"] == "ACTTANNTACGN" and full["B"] == "NNTTACGTACGT" and full["ref"] == REF
    with pytest.raises(ValueError):
        q.alignment("ref", "other")
    cli.main(["--project", str(d / "with"), "build", "tree", "--reference-name", "ref", "--align-type", "core"], spark)
    assert "A" in capsys.readouterr().out


def test_masked_positions_are_no_core(spark, tmp_path):
    own = SampleIndex(spark, str(tmp_path / "own"))
    own.add_reference("one", spark.createDataFrame([("r", "ACGTACGT")], "sequence string, bases string"))
    own.add_reference("two", spark.createDataFrame([("p", "TTTT")], "sequence string, bases string"))
    v = [("a", "r", 2, "C", "G", "SNP"), ("b", "r", 6, "C", "T", "SNP"), ("a", "p", 1, "T", "A", "SNP"), ("c", "r", 6, "C", "T", "SNP")]
    masks = spark.createDataFrame([("c", "r", 1, 2)], "sample string, sequence string, start0 long, end0 long")
    own.add_variants(spark.createDataFrame(v, "sample string, chrom string, pos int, ref string, alt string, type string"), masks)
    q = SamplesQuery.on_reference(own, "one")
    assert {r["record_id"]: r["alignment"] for r in q.alignment("one", "core").collect()} == {"one": "C", "a": "C", "b": "T", "c": "T"}
    full = q.build_tree("mutation", reference_name="one")
    assert sorted(full.root.leaf_names()) == ["a", "b", "c", "one"] and full.alignment_length == 8
    assert full.isin("b", kind="distance", distance=0.5, units="substitutions").toset() == {"b", "c"}
    with pytest.raises(ValueError, match="reference"):
        q.build_tree("mutation")
    own.rebuild_tree("one", "core")
    assert own.stored_tree("one")[1] == 1 and SamplesQuery.on_reference(own, "one").reference_leaf == "one"


def test_experimental_tree_follows_the_selection(spark, index):
    q = SamplesQuery.all(index).reset_universe().join_tree("(genome:0,A:2,(B:1,C:1):1);", 10, "genome").experimental()
    assert sorted(q.isa("A").root.leaf_names()) == ["A", "genome"]
    assert sorted(q.isa("A").complement().root.leaf_names()) == ["B", "C", "genome"]
    b = q.isa(["B", "C"])
    assert sorted(b.universe_root.leaf_names()) == ["A", "B", "C", "genome"]
    assert sorted(b.reset_universe(include_unknown=False).universe_root.leaf_names()) == ["B", "C", "genome"]
    assert b.isin("B", kind="distance", distance=20, units="substitutions").toset() == {"B", "C"}


def test_metadata_columns_of_any_name(spark, index):
    at = {r["sample_name"]: r["sample_id"] for r in index.samples.collect()}
    rows = [(at["A"], "red", "x", "n1", 1.0, "A"), (at["B"], "blue", "y", "n2", 2.0, "B"), (at["C"], "blue", "z", "n3", 3.0, "C")]
    m = spark.createDataFrame(rows, "`Sample ID` long, `Status` string, Query string, `sample name` string, `a.b` double, name string")
    q = SamplesQuery.all(index).join(m, sample_ids_column="Sample ID").join_tree("(A:2,(B:1,C:1):1);")
    frame = q.toframe()
    assert frame.columns == ["Query", "Sample Name", "Sample ID", "Status", "Status_metadata", "Query_metadata", "sample name_metadata", "a.b", "name"]
    got = {r["Sample Name"]: r for r in frame.collect()}
    assert got["B"]["Status"] == "Present" and got["B"]["Status_metadata"] == "blue" and got["B"]["a.b"] == 2.0 and got["B"]["Sample ID"] == at["B"]
    assert q.isa("blue", kind="dataframe", column="Status").toset() == {"B", "C"} and q.isa("2.0", kind="dataframe", column="a.b").toset() == {"B"}
    scores = {r["group"]: (r["samples"], r["score"]) for r in q.score_groups("Status").collect()}
    assert scores == {"red": (1, 1.0), "blue": (2, 1.0)} and q.score_groups("name").count() == 3
    compared = q.features_comparison("Status").columns
    assert any("blue" in c for c in compared) and any("red" in c for c in compared)
    leaves = {r["leaf"] for r in q.tree_annotations({"x": q}, leaf_name=lambda n: F.concat_ws("|", n, "Status", "name_metadata")).collect()}
    assert leaves == {"A|red|A", "B|blue|B", "C|blue|C"}
    with pytest.raises(ValueError, match="sample_id"):
        SamplesQuery.all(index).join(m.withColumn("sample_id", F.lit(1)), sample_ids_column="Sample ID")


def test_experimental_steps_are_lazy(spark, index):
    q = SamplesQuery.all(index).reset_universe().join_tree("(A:2,(B:1,C:1):1);").experimental()
    seen = []
    from triloom.operators import paths

    plain, paths.pruned = paths.pruned, lambda *a: seen.append(1) or plain(*a)
    try:
        step = q.isa("A").complement().reset_universe()
        assert seen == [] and sorted(step.root.leaf_names()) == ["B", "C"] and seen == [1]
    finally:
        paths.pruned = plain


def test_annotated_summaries_can_be_asked_for_again(spark, index):
    rows = SamplesQuery.all(index).features_summary(ignore_annotations=False).where("id_hgvs_gn_c is not null").collect()
    assert rows
    for r in rows:
        assert SamplesQuery.all(index).hasa(r["id_hgvs_gn_c"]).toset() == SamplesQuery.all(index).hasa(r["feature"]).toset()


def test_leaf_names_and_styles(spark, index):
    m = spark.createDataFrame([("A", "red"), ("B", "blue"), ("C", None)], "who string, color string")
    q = SamplesQuery.all(index).join(m, sample_names_column="who").join_tree("(A:2,(B:1,C:1):1);")
    rows = q.tree_annotations({"x": q.isa("A"), "y": ~q.isa("A")}, leaf_name=lambda n: F.concat_ws("|", n, "color")).collect()
    assert {(r["leaf"], r["column"], r["color"]) for r in rows} == {("A|red", "x", "black"), ("A|red", "y", "white"), ("B|blue", "x", "white"), ("B|blue", "y", "black"), ("C", "x", "white"), ("C", "y", "black")}
    assert q.label_internal(lambda names: "+".join(names)).name == "A+B+C"


def test_projects(spark, tmp_path):
    root = str(tmp_path / "p")
    with pytest.raises(ValueError, match="init"):
        open_project(spark, root)
    assert init_project(spark, root).root == f"{root}/data"
    with pytest.raises(ExistsError):
        init_project(spark, root)
    (tmp_path / "p" / "triloom.json").write_text('{"format": 1, "data": "/elsewhere"}')
    assert open_project(spark, root).root == "/elsewhere"
    (tmp_path / "p" / "triloom.json").write_text('{"format": 9}')
    with pytest.raises(ValueError):
        open_project(spark, root)


def test_analysis(spark, tmp_path, capsys):
    """From files of samples and a folder of results to an index; missing and known ones are skipped."""
    d = tmp_path
    (d / "ref.fa").write_text(f">ref\n{REF}\n")
    (d / "out" / "y").mkdir(parents=True)
    for s in ("x", "y", "z"):
        (d / f"{s}.fa").write_text(f">c\n{'ACGTTGCATTAGCCGATAGGCTTAACGGATCCA' * 2}\n")
    (d / "out" / "x.vcf").write_text(HEAD + "ref\t3\t.\tG\tT\t.\t.\tTYPE=SNP\n")
    (d / "out" / "x.bed").write_text("ref\t4\t5\n")
    (d / "out" / "y" / "snps.vcf").write_text(HEAD + "ref\t5\t.\tA\tC\t.\t.\tTYPE=SNP\n")
    root = str(d / "p")
    cli.main(["--project", root, "init"], spark)
    call = ["--project", root, "analysis", "--reference-file", str(d / "ref.fa"), "--artefacts", str(d / "out")]
    files = [str(d / f"{s}.fa") for s in ("x", "y", "z", "gone")]
    cli.main([*call, "--no-load-data", *files], spark)
    shown = capsys.readouterr()
    assert "x.vcf" in shown.out and "gone" in shown.err and "z" in shown.err
    assert open_project(spark, root).count_samples() == 0
    cli.main([*call, "--include-kmer", "--kmer-scaled", "1", "--kmer-size", "21", "--build-tree", *files], spark)
    i = open_project(spark, root)
    assert i.sample_names() == ["x", "y"] and i.has_kmer_index("x") and i.stored_tree("ref")
    assert i.samples_query().hasa("ref:5:1:C").toset(include_unknown=True) == {"x", "y"}
    cli.main([*call, "--skip-existing-samples", *files], spark)
    assert "x" in capsys.readouterr().err and i.count_samples() == 2


def test_signature_files(spark, tmp_path):
    doc = formats.signature("A", {21: [5, -1], 31: [7]}, abundances={21: [2, 9], 31: [1]})
    protein = {"name": "A", "signatures": [{"ksize": 7, "mins": [3], "molecule": "protein"}]}
    (tmp_path / "a.sig").write_text(json.dumps([doc, protein]))
    got = sorted((r["sample"], r["ksize"], r["hash"], r["abundance"]) for r in readers.signatures(spark, str(tmp_path / "a.sig")).collect())
    assert got == [("A", 21, -1, 9), ("A", 21, 5, 2), ("A", 31, 7, 1)]
    rows = [("A", 21, -1), ("A", 21, 5), ("A", 31, 7), ("B", 21, 5)]
    sinks.signatures(spark.createDataFrame(rows, "sample string, ksize int, hash long").coalesce(1), str(tmp_path / "sigs"))
    assert sorted((r["sample"], r["ksize"], r["hash"]) for r in readers.signatures(spark, str(tmp_path / "sigs")).collect()) == rows
    with pytest.raises(ValueError):
        list(formats.signature_hashes(json.dumps({"name": "A", "signatures": [{"ksize": 3, "mins": [1], "seed": 7}]}).encode()))


def test_comparison_by_a_column_of_too_many_values(spark, index, monkeypatch):
    from triloom import query

    monkeypatch.setattr(query, "MOST_CATEGORIES", 1)
    m = spark.createDataFrame([("A", "red"), ("B", "blue")], "who string, color string")
    with pytest.raises(ValueError, match="values"):
        SamplesQuery.all(index).join(m, sample_names_column="who").features_comparison("color")
    monkeypatch.setattr(query, "MOST_LEAVES", 1)
    with pytest.raises(ValueError, match="subsample"):
        SamplesQuery.all(index).build_tree("mutation", reference_name="ref")


def test_summaries_are_planned_without_a_job(spark, index):
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    rows = SamplesQuery.all(index).isa("A").features_summary()
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert {r["total"] for r in rows.collect()} == {1}


def test_sample_sets(spark):
    from triloom.operators.sample_set import SampleSet

    of = lambda *x: SampleSet.of(spark.createDataFrame([(i,) for i in x], "sample_id long"))
    ids_of = lambda s: sorted(r[0] for r in s.ids.collect())
    a, b = of(1, 2, 3, 3, None), of(3, 4)
    assert ids_of(a.intersection(b)) == [3] and ids_of(a.union(b, of(9))) == [1, 2, 3, 4, 9] and ids_of(a.minus(b, of(1))) == [2] and ids_of(a.minus()) == [1, 2, 3]
    assert a.jaccard(b).first()[0] == 0.25 and len(a) == 3 and 2 in a and 9 not in a
    none = SampleSet.empty(spark)
    assert none.is_empty() and not a.is_empty() and ids_of(a.minus(none)) == [1, 2, 3] and a.described(7).first()["contains"] is False


def test_many_variants_overlap_in_a_consensus(spark):
    """Edits are put in by place, masks over them; what reaches beyond the end is left out."""
    s = spark.createDataFrame([(1, "a"), (2, "b")], "sample_id long, sample_name string")
    r = spark.createDataFrame([("c", "ACGTACGTAC")], "sequence string, bases string")
    calls = [(1, "c", 2, 3, "T", "INDEL"), (1, "c", 4, 1, "G", "SNP"), (1, "c", 9, 3, "GTA", "MNP"), (1, "c", 6, 1, "CAA", "INDEL")]
    c = spark.createDataFrame(calls, "sample_id long, sequence string, position int, deletion int, insertion string, var_type string")
    m = spark.createDataFrame([(1, "c", 0, 1), (1, "c", 8, 9)], "sample_id long, sequence string, start0 long, end0 long")
    got = {x["record_id"]: x["bases"] for x in align.consensus(c, s, r, m).collect()}
    assert got == {"a": "NT-GACGTNT", "b": "ACGTACGTAC"}


def test_counts_of_a_stream(spark, tmp_path):
    from triloom.streaming.ingest import stream_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("2024-01-01T00:01:00Z,SNP\n2024-01-01T00:02:00Z,SNP\n2024-01-01T00:07:00Z,INDEL\n")
    calls = spark.readStream.schema("at timestamp, var_type string").csv(str(tmp_path / "in"))
    run = stream_counts(calls, "at").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["var_type"], r["n"]) for r in spark.table("counted").collect()) == [("INDEL", 1), ("SNP", 2)]


def test_a_load_reads_the_folders_it_touches(spark, tmp_path):
    own = SampleIndex(spark, str(tmp_path / "own"))
    v = lambda s, *at: spark.createDataFrame([(s, c, p, "A", "C", "SNP") for c, p in at], "sample string, chrom string, pos int, ref string, alt string, type string")
    own.add_variants(v("a", ("r", 5), ("r", 70_000), ("r", 200_000), ("q", 5)))
    one = v("b", ("r", 70_001)).selectExpr("chrom as sequence", "cast(floor(pos / 65536) as int) as bin")
    read = own.touched("calls", one)
    assert [r["position"] for r in read.collect()] == [70_000]
    plan = read._jdf.queryExecution()
    plan.toRdd().count()
    assert plan.executedPlan().collectLeaves().head().metrics().apply("numFiles").value() == 1
    for _ in range(3):
        own.add_variants(v("b", ("r", 70_001), ("r", 5)), allow_existing=True)
    own.add_variants(v("a", ("r", 5)), allow_existing=True)
    want = sorted(map(tuple, own.calls.collect()))
    assert len(want) == 6
    from pathlib import Path

    before = len(list(Path(own.root, "calls").rglob("*.parquet")))
    own.compact("calls")
    own.compact("kmer")
    assert sorted(map(tuple, own.calls.collect())) == want and len(list(Path(own.root, "calls").rglob("*.parquet"))) == 4 < before
    assert sorted(p.name for p in Path(own.root).iterdir() if p.name.startswith("calls")) == ["calls"]
    own.add_variants(v("c", ("r", 6)), allow_existing=True)
    assert own.calls.count() == 7


def test_sets_and_compaction_from_the_command_line(spark, files, tmp_path, capsys):
    p = ["--project", str(tmp_path / "own")]
    cli.main([*p, "init"], spark)
    cli.main([*p, "load", "vcf", str(files / "fofn.tsv"), "--reference-file", str(files / "ref.fasta.gz"), "--reference-name", "genome"], spark)
    index = open_project(spark, p[1])
    before = sorted(map(tuple, index.mutation_counts("genome").collect()))
    for what in ("sets", "compact"):
        assert cli.main([*p, "db", what], spark) == 0
        assert "sample_sets" in capsys.readouterr().out
        assert sorted(map(tuple, index.mutation_counts("genome").collect())) == before and before


def test_bitmaps_of_rare_features_are_small_rows(spark):
    """A row holds 64 ids, not a bitmap of thousands of bytes; ids may be negative or large."""
    rows = [("a", -65), ("a", -1), ("a", 0), ("a", 63), ("a", 64), ("b", 2**40), ("c", 127), ("c", 127)]
    m = to_bitmaps(spark.createDataFrame(rows, "feature string, sample_id long"))
    assert all(t in ("string", "bigint") for _, t in m.dtypes)
    assert sorted(map(tuple, from_bitmaps(m).collect())) == sorted(set(rows))
    got = {r[0]: tuple(r[1:]) for r in described(m).collect()}
    assert got == {"a": (5, -65, 64, 61), "b": (1, 2**40, 2**40, 2**40), "c": (1, 127, 127, 127)}
    plan = sizes(union_bitmaps(m, m))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_distances_of_chosen_samples_are_a_table(spark, monkeypatch):
    """The query's pairs are those of the matrix, and no square comes to the driver for them."""
    import numpy as np

    from triloom.operators import kmer
    from triloom.plans import catalog
    from triloom.plans.projection import Tables
    from triloom.query import SamplesQuery

    t = Tables(spark, "/root/testdata/sf0.001")
    on = SamplesQuery.all(t).intersect(t.with_kmer_index())
    order, m = on.to_distances(kmer_size=3)
    want = {(order[i], order[j]): m[i, j] for i, j in zip(*np.nonzero(np.triu(m < 1, 1)), strict=True)}
    monkeypatch.setattr(kmer, "distance_matrix", None)
    got = catalog.queries()["to_distances"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["sample_a"], r["sample_b"]): r["distance"] for r in got} == want


def test_signature_documents_are_read_one_at_a_time(spark, tmp_path):
    """The hashes of the first document come before the next one is parsed, and files hold a bounded number."""
    import json

    from triloom.sources import formats, readers, sinks

    one = json.dumps([{"name": "a", "signatures": [{"ksize": 31, "mins": [1, 2**64 - 1]}]}])
    found = formats.signature_hashes((one + "\n{broken").encode())
    assert [next(found), next(found)] == [("a", 31, 1, 1), ("a", 31, -1, 1)]
    rows = [(f"s{i}", 31, i) for i in range(1100)]
    sinks.signatures(spark.createDataFrame(rows, "sample string, ksize int, hash long").coalesce(1), str(tmp_path / "sig"))
    files = [len(p.read_text().splitlines()) for p in (tmp_path / "sig").glob("part-*")]
    assert max(files) <= 1000 and sum(files) == 1100
    got = readers.signatures(spark, str(tmp_path / "sig")).select("sample", "ksize", "hash").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_sheet_of_file_pairs_is_written_by_tasks(spark, monkeypatch):
    """A pair of files for each supplier: none of them goes through the driver."""
    from triloom.plans import catalog, q_files

    def refuse(*a, **k):
        raise AssertionError("a file written by the driver")

    monkeypatch.setattr(q_files, "write_text", refuse)
    folder = "/root/testdata/sf0.001"
    rows = catalog.queries()["scan_vcf_kmer_fofn"](spark, folder).collect()
    want = {(f"S{r['s_suppkey']}", "chr0", 2 + r["s_nationkey"], "C", 2) for r in spark.read.parquet(f"{folder}/supplier.parquet").collect()}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_paths_of_a_sheet_are_those_of_the_file_system(spark, tmp_path):
    from triloom.sources import readers

    path = spark._jvm.org.apache.hadoop.fs.Path
    for p in ("/a/b c.vcf", "file:/a/b%20c.vcf", "file:///a//b/", "hdfs://host:90/x/y+z", "/a/é#?.vcf"):
        assert readers._uri_path(spark, p) == path(p).toUri().getPath()
    assert readers._uri_path(spark, "here.vcf").endswith("/here.vcf")
    for name in ("b c+%41.vcf", "é.vcf"):
        (tmp_path / name).write_text("c\t1\t.\tA\tC\t.\t.\tTYPE=SNP\n")
    sheet = [("s1", f"{tmp_path}/b c+%41.vcf"), ("s2", f"file://{tmp_path}/é.vcf")]
    found = readers.sheet_files(spark, sheet, lambda paths: readers.vcf(spark, paths)).collect()
    assert sorted(r["sample"] for r in found) == ["s1", "s2"]
