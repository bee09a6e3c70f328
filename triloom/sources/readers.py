"""Readers of the file formats that samples arrive in; each gives a DataFrame, parsed on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.functions import ids
from triloom.session import ship

# Text tables.


def vcf(spark: SparkSession, paths: str | list[str], sample: str | None = None) -> DataFrame:
    """VCF records: first ALT only, TYPE from INFO or else from the alleles, ANN as an array.

    Plain or gzipped text, one DataFrame for all files; the sample is the file name up to its first
    dot unless given. No Python on the way.
    """
    return vcf_lines(spark.read.text(paths).withColumn("file", F.input_file_name()), sample)


def vcf_lines(lines: DataFrame, sample: str | None = None) -> DataFrame:
    """The same from lines (file, value)."""
    lines = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    alt = F.split(f[4], ",")[0]
    info = F.expr("str_to_map(split(value, '\t')[7], ';', '=')")
    t = lines.select("file", f[0].alias("chrom"), f[1].cast("int").alias("pos"), F.upper(f[3]).alias("ref"), F.upper(alt).alias("alt"), info.alias("info"))
    kind = F.upper(F.split(F.col("info")["TYPE"], ",")[0])
    kind = F.when(kind.isin("SNP", "MNP"), kind).when(kind.isin("INS", "DEL", "INDEL"), "INDEL").when(kind.isNotNull(), "OTHER")
    t = t.withColumn("type", F.coalesce(kind, ids.variant_type(F.col("ref"), F.col("alt"))))
    name = F.lit(sample) if sample else ids.sample_from_filename(F.col("file"))
    key = F.concat_ws(":", "chrom", F.col("pos").cast("string"), F.length("ref").cast("string"), "alt")
    return t.select(name.alias("sample"), "chrom", "pos", "ref", "alt", "type", "file", key.alias("variant_id"), "info", F.split(F.col("info")["ANN"], ",").alias("ann"))


def ann_names(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The ANN fields' names from the VCFs' headers; empty without one, an error where they differ."""
    from triloom.operators.annotate import ann_header

    d = spark.read.text(path).where(F.col("value").startswith("##INFO=<ID=ANN"))
    found = d.select(ann_header(F.regexp_extract("value", 'Description="(.*)"', 1)).alias("n")).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("the files name their annotation fields differently; load them apart")
    return list(found[0]["n"]) if found else []


def vcf_with_annotations(spark: SparkSession, paths: str | list[str], names: list[str], sample: str | None = None) -> DataFrame:
    """VCF records with the best annotation of each."""
    v = vcf(spark, paths, sample)
    return _annotated(v, names)


def _annotated(v: DataFrame, names: list[str]) -> DataFrame:
    from triloom.operators import annotate

    short = {"Allele": "Allele", "Annotation": "annotation", "Annotation_Impact": "impact", "Gene_Name": "gene_name", "Gene_ID": "gene_id", "HGVS.c": "hgvs_c", "HGVS.p": "hgvs_p", "cDNA.pos / cDNA.length": "cdna"}
    a = annotate.explode_ann(v.select("variant_id", "ann").where("ann is not null").distinct(), names)
    a = a.select("variant_id", *[F.col(f"`{k}`").alias(n) for k, n in short.items()])
    return annotate.with_best_annotation(v, a)


def repeated(names: DataFrame, column: str) -> DataFrame:
    """(column, n) of the names that occur more than once, which a sheet may not hold."""
    return names.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def vcf_fofn(spark: SparkSession, path: str) -> DataFrame:
    """TSV Sample, VCF, Mask File[, Sketch File]; a repeated sample is an error, a missing mask is null."""
    t = spark.read.csv(path, sep="\t", header=True)
    twice = repeated(t, "Sample").limit(10).collect()
    if twice:
        raise ValueError(f"samples named more than once: {', '.join(r[0] for r in twice)}")
    na = lambda c: F.when(F.col(c).isin("", "NA", "nan"), None).otherwise(F.col(c)).alias(c)
    return t.select("Sample", "VCF", *[na(c) for c in t.columns if c not in ("Sample", "VCF")])


#: Files that are named in one read.
_FILES = 1000


def _uri_path(spark: SparkSession, path: str) -> str:
    """The path within its file system; only a relative one is asked of the file system."""
    whole = re.fullmatch(r"(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?(/[^/].*)", path)
    if whole:
        return re.sub("/+", "/", whole[1]).rstrip("/")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath()


def _by_path(spark: SparkSession, rows: DataFrame, sheet: list[tuple[str, str]]) -> DataFrame:
    """The rows with the sample that a sheet of (sample, path) gives their file, by the path within its file system.
    Of a path that is named twice the last sample counts."""
    names = {_uri_path(spark, p): s for s, p in sheet}
    named = spark.createDataFrame(list(names.items()), "_path string, _sample string")
    path = F.regexp_replace(F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:(//[^/]*)?", "")
    found = rows.withColumn("_path", path).join(F.broadcast(named), "_path", "left")  # a thousand rows at most
    return found.withColumn("sample", F.col("_sample")).drop("_path", "_sample")


def sheet_files(spark: SparkSession, sheet: list[tuple[str, str]], read) -> DataFrame | None:
    """One table of all files of a sheet of (sample, path): read(paths) gives rows with a column
    `file`, and `sample` is filled in from the sheet. Files are named a thousand at a time and read
    side by side, in one job of the caller, not a job a sample."""
    out = None
    for i in range(0, len(sheet), _FILES):
        part = sheet[i : i + _FILES]
        rows = read([p for _, p in part])
        rows = _by_path(spark, rows, part)
        out = rows if out is None else out.union(rows)
    return out


def kmer_files(sheet: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(Sample, File) from a sheet (Sample, Files): a comma list a sample; samples in known (sample_name) are skipped."""
    t = sheet.select("Sample", F.explode(F.split("Files", ",")).alias("File"))
    return t if known is None else t.join(known.select(F.col("sample_name").alias("Sample")), "Sample", "left_anti")


def kmer_fofn(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    return kmer_files(spark.read.csv(path, sep="\t", header=True), known)


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.csv(path, sep="\t", header=True)
    if t.columns != ["Sample", "Assemblies", "Reads1", "Reads2"]:
        raise ValueError(f"columns must be Sample, Assemblies, Reads1, Reads2, not {t.columns}")
    return t


def genome_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sorted and merged intervals of BED files (sample, sequence, start0, end0)."""
    from triloom.operators import intervals

    rows = bed_rows(spark, paths).withColumn("sample", ids.sample_from_filename(F.col("file")))
    return intervals.merge(rows, ["sample", "sequence"])


def bed_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, sequence, start0, end0): the intervals as they stand."""
    t = spark.read.text(paths).withColumn("file", F.input_file_name()).where(~F.col("value").rlike("^(#|track|browser|\\s*$)"))
    f = F.split("value", r"\t")
    return t.select("file", f[0].alias("sequence"), f[1].cast("long").alias("start0"), f[2].cast("long").alias("end0"))


def sequence_masks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, sequence, start0, end0): what sequence files lack, their runs of N and -."""
    from triloom.operators import intervals

    s = sequences(spark, paths)
    key = F.concat_ws("\x01", "file", "sequence")
    gone = intervals.from_sequences(s.select(key.alias("sequence"), "bases"))
    p = F.split("sequence", "\x01")
    return gone.select(p[0].alias("file"), p[1].alias("sequence"), "start0", "end0")


# MLST tables.


def _tidy(rows: DataFrame) -> DataFrame:
    return rows.select(ids.sample_from_filename(F.col("file")).alias("sample"), "scheme", "locus", ids.validate_allele(F.col("allele")).alias("allele"))


def mlst_tseemann(lines: DataFrame, scheme: str | None = None) -> DataFrame:
    """From lines (value): tab-separated File, Scheme, ST, locus(allele)..."""
    f = F.split("value", "\t")
    t = lines.where(F.trim("value") != "").select(f[0].alias("file"), f[1].alias("scheme"), F.explode(F.slice(f, 4, F.greatest(F.size(f) - 3, F.lit(0)))).alias("c"))
    if scheme:
        t = t.withColumn("scheme", F.lit(scheme))
    p = r"^([^\(]*)\(([^\)]*)\)"
    return _tidy(t.where(F.col("c").rlike(p)).select("file", "scheme", F.regexp_extract("c", p, 1).alias("locus"), F.regexp_extract("c", p, 2).alias("allele")))


def melt(wide: DataFrame, file_column: str, scheme: str) -> DataFrame:
    loci = [c for c in wide.columns if c != file_column]
    t = wide.select(F.col(f"`{file_column}`").cast("string").alias("file"), *[F.col(f"`{c}`").cast("string").alias(c) for c in loci])
    return t.unpivot(["file"], [f"`{c}`" for c in loci], "locus", "allele").withColumn("scheme", F.lit(scheme))


def mlst_wide(wide: DataFrame, scheme: str, file_column: str | None = None) -> DataFrame:
    """Allele rows of a table with a column a locus and one of files (the first, unless named)."""
    return _tidy(melt(wide, file_column or wide.columns[0], scheme))


def mlst_sistr(spark: SparkSession, path: str, scheme: str = "sistr_330") -> DataFrame:
    return mlst_wide(spark.read.csv(path, header=True), scheme)


def mlst_chewbbaca(spark: SparkSession, path: str, scheme: str) -> DataFrame:
    return mlst_wide(spark.read.csv(path, sep="\t", header=True), scheme, "FILE")


def with_scheme(rows: DataFrame, scheme: str) -> DataFrame:
    """Allele rows under a scheme's name of one's own."""
    return rows.withColumn("scheme", F.lit(scheme)).distinct()


def metadata(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table of sample attributes with a header; numbers are told from text."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def existing_files(spark: SparkSession, sheet: list[tuple], columns: tuple[int, ...] = (1, 2, 3)) -> tuple[list[tuple], list[str]]:
    """(rows whose files are all there, samples that are skipped) of rows (sample, files or None...);
    each file is looked up on its own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(path: str | None) -> bool:
        if not path:
            return True
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    kept = [r for r in sheet if all(there(r[i]) for i in columns if i < len(r))]
    names = {r[0] for r in kept}
    return kept, [r[0] for r in sheet if r[0] not in names]


# Sequence files.


def sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, sequence, bases) of FASTA and GenBank files, plain or compressed (gz, xz, bz2)."""
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        import pandas as pd

        from triloom.sources.formats import records, unpacked

        for t in batches:
            rows = [(p, n, s) for p, c in zip(t["path"], t["content"], strict=True) for n, s in records(p, unpacked(p, bytes(c)))]
            yield pd.DataFrame(rows, columns=["file", "sequence", "bases"])

    return files.mapInPandas(run, "file string, sequence string, bases string")


#: Hashes of signature files that a task holds as rows at once.
_HASHES = 100_000


def signatures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sample, ksize, hash, abundance, file) of k-mer signature files (JSON, plain or gzipped);
    abundance is 1 where a file holds none."""
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        from itertools import islice

        import pandas as pd

        from triloom.sources.formats import signature_hashes, unpacked

        for t in batches:
            for p, c in zip(t["path"], t["content"], strict=True):
                found = ((*r, p) for r in signature_hashes(unpacked(p, bytes(c))))
                while rows := list(islice(found, _HASHES)):
                    yield pd.DataFrame(rows, columns=["sample", "ksize", "hash", "abundance", "file"]).astype({"ksize": "int32", "hash": "int64", "abundance": "int64"})

    return files.mapInPandas(run, "sample string, ksize int, hash long, abundance long, file string")


def snippy_dirs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Variants and masks of a folder of sample folders, each with snps.vcf(.gz) and snps.aligned.fa;
    a sample is its folder, its mask is what the aligned sequence lacks less what its variants span."""
    from triloom.operators import intervals

    folder = lambda c: F.regexp_extract(c, r"([^/]+)/snps\.[^/]*(?:/[^/]*)?$", 1)
    v = vcf(spark, f"{root}/*/snps.vcf*").withColumn("sample", folder(F.col("file")))
    s = sequences(spark, f"{root}/*/snps.aligned.fa").withColumn("sample", folder(F.col("file")))
    key = F.concat_ws("\x01", "sample", "sequence")
    split = lambda t: t.select(F.split("sequence", "\x01")[0].alias("sample"), F.split("sequence", "\x01")[1].alias("sequence"), "start0", "end0")
    gone = split(intervals.from_sequences(s.select(key.alias("sequence"), "bases")))
    start = F.col("pos").cast("long") - 1
    spans = v.select("sample", F.col("chrom").alias("sequence"), start.alias("start0"), (start + F.length("ref")).alias("end0"))
    return v, intervals.subtract(gone, spans, ["sample", "sequence"])


def mask_source(path: str | None) -> str:
    """How a mask file is read: 'bed' (or none at all), 'sequence', else an error."""
    import re

    if path is None or re.search(r"\.bed(\.gz)?$", path):
        return "bed"
    if re.search(r"\.(fasta|fa|fna)(\.(gz|xz|bz2))?$", path):
        return "sequence"
    raise ValueError(f"{path} is neither a BED file nor a sequence")


def constellations(spark: SparkSession, paths: str | list[str], to_id) -> dict:
    """Typing definitions by label, of files that hold one or several each; they all come to the driver."""
    from triloom.operators.typing import definitions

    rows = spark.read.text(paths, wholetext=True).select("value", F.input_file_name().alias("f")).orderBy("f").collect()
    return definitions([r["value"] for r in rows], to_id)


# Rows of input files.


def mask_kind(path: Column) -> Column:
    """mask_source() of a column of paths."""
    return (
        F.when(path.isNull() | path.rlike(r"\.bed(\.gz)?$"), "bed")
        .when(path.rlike(r"\.(fasta|fa|fna)(\.(gz|xz|bz2))?$"), "sequence")
        .otherwise(F.raise_error(F.concat(path, F.lit(" is neither a BED file nor a sequence"))))
    )


def paired_files(files: DataFrame) -> DataFrame:
    """(sample, assembly, reads1, reads2) from files (path), as pair_reads() has it, for any number of them;
    inputs of one sample name are an error."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.(gz|xz|bz2)$", ""), r"\.(fasta|fa|fna|fastq|fq|gb|gbk|gbff)$", "")
    f = files.select("path", base.alias("base"), F.col("path").rlike(r"\.(fastq|fq)(\.(gz|xz|bz2))?$").alias("read"))
    mark = F.coalesce(*[F.when(F.col("base").contains(m), m) for m in ids.PAIR_MARKS])
    f = f.withColumn("mark", F.when(F.col("read"), mark))
    before = F.length("base") - F.length("mark") - F.expr("locate(reverse(mark), reverse(base))") + 1
    f = f.withColumn("before", before).withColumn("stem", F.expr("left(base, before)")).withColumn("end", F.right("mark", F.lit(1)))
    f = f.withColumns({"kind": F.expr("left(mark, length(mark) - 1)"), "rest": F.expr("substring(base, before + length(mark) + 1)")})
    one = f.where("mark is not null").groupBy("stem", "kind", "rest").agg(F.sort_array(F.collect_list(F.struct("end", "path", "base"))).alias("ends"))
    whole = (F.size("ends") == 2) & F.array_join(F.col("ends.end"), "").isin("12", "fr")
    pairs = one.where(whole).select(F.col("stem").alias("sample"), F.lit(None).cast("string").alias("assembly"), F.col("ends")[0]["path"].alias("reads1"), F.col("ends")[1]["path"].alias("reads2"))
    lone = one.where(~whole).select(F.explode("ends").alias("e")).select(F.col("e.base").alias("base"), F.col("e.path").alias("path"), F.lit(True).alias("read"))
    lone = lone.union(f.where("mark is null").select("base", "path", "read"))
    lone = lone.select(F.col("base").alias("sample"), F.when(~F.col("read"), F.col("path")).alias("assembly"), F.when(F.col("read"), F.col("path")).alias("reads1"), F.lit(None).cast("string").alias("reads2"))
    out = pairs.union(lone)
    twice = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("several inputs give the sample name "), F.col("sample")))).otherwise(F.lit(True))
    return out.groupBy("sample").agg(F.first("assembly").alias("assembly"), F.first("reads1").alias("reads1"), F.first("reads2").alias("reads2"), twice.alias("_one")).where("_one").drop("_one")


def pair_reads(files: list[str]) -> list[tuple[str, str | None, str | None, str | None]]:
    """(sample, assembly, reads 1, reads 2): files of reads pair up if their names differ in one mark
    1/2 or f/r only; other files are assemblies or single reads."""
    import re

    from triloom.functions.ids import PAIR_MARKS

    base = {f: re.sub(r"\.(fasta|fa|fna|fastq|fq|gb|gbk|gbff)$", "", re.sub(r"\.(gz|xz|bz2)$", "", f.rsplit("/", 1)[-1])) for f in files}
    reads = [f for f in files if re.search(r"\.(fastq|fq)(\.(gz|xz|bz2))?$", f)]
    stem, out, left = {}, [], set(reads)
    for f in reads:
        mark = next((m for m in PAIR_MARKS if m in base[f]), None)
        if mark:
            at = base[f].rindex(mark)
            stem.setdefault((base[f][:at], mark.rstrip("12fr"), base[f][at + len(mark) :]), []).append((mark[-1], f))
    for (name, _, _), both in sorted(stem.items()):
        if sorted(m for m, _ in both) in (["1", "2"], ["f", "r"]):
            (_, a), (_, b) = sorted(both)
            out.append((name, None, a, b))
            left -= {a, b}
    out += [(base[f], None, f, None) for f in reads if f in left]
    out += [(base[f], f, None, None) for f in files if f not in reads]
    names = [r[0] for r in out]
    if len(set(names)) < len(names):
        raise ValueError("several inputs give one sample name")
    return sorted(out, key=lambda r: r[0])


def random_sequences(seqs: DataFrame, k: float, seed: int = 0) -> DataFrame:
    """k records (k >= 1) or that share of them, by a hash of seed and name."""
    n = seqs.count()
    take = int(k) if k >= 1 else round(k * n)
    return seqs.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "sequence")), "sequence").limit(take)

