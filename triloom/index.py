"""A warehouse of parquet tables: ingest, upsert and lookups of samples, features and references."""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triloom import schema
from triloom.functions import ids
from triloom.operators import bitmaps
from triloom.session import write_text, written
from triloom.view import IndexView


#: Folders that a load may touch to have just those listed; with more, the table is joined by folder.
MOST_FOLDERS = 2000


class ExistsError(ValueError):
    """Something to be added is there already."""


# Pure functions behind the sinks.

#: Names that are numbered at once: a batch is cut into so many ranges.
_RANGES = 64


def numbered(names: DataFrame, column: str) -> DataFrame:
    """(column, n): distinct values numbered from 1 in order. The driver picks _RANGES splitters, by a
    hash so that reruns agree, and gets a count for each range; ranges are numbered side by side."""
    picked = [r[0] for r in names.select(column).orderBy(F.xxhash64(column), column).limit(_RANGES * 16).collect()]
    splitters = sorted(picked)[:: max(1, len(picked) // _RANGES)]
    below = F.array(*[F.lit(s) for s in splitters]) if splitters else F.array().cast("array<string>")
    ranged = names.select(column, F.size(F.filter(below, lambda s: s <= F.col(column))).alias("_range"))
    at, starts = 0, []
    for r in sorted(ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        starts.append((r["_range"], at))
        at += r["n"]
    start = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.col("_range")] if starts else F.lit(0)
    own = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.select(column, (start + own).cast("long").alias("n"))


def new_samples(samples: DataFrame, names: DataFrame) -> DataFrame:
    """(sample_id, sample_name) for the names that are not there yet, numbered on in order of name."""
    fresh = names.select("sample_name").distinct().join(samples, "sample_name", "left_anti")
    top = samples.agg(F.coalesce(F.max("sample_id"), F.lit(0)).alias("_top"))
    return numbered(fresh, "sample_name").crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("n")).alias("sample_id"), "sample_name")  # top is one row


def fresh_rows(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One of the new rows for each key that does not exist yet: the least of several."""
    rest = [c for c in new.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else new.distinct()
    return once.join(existing.select(*key), key, "left_anti").select(*new.columns)


def upsert_calls(calls: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old and new rows, one for each key; an old row wins, so a repeated ingest changes nothing."""
    return calls.unionByName(fresh_rows(calls, new, key).select(*calls.columns))


def _call_sets(calls: DataFrame) -> DataFrame:
    return bitmaps.to_bitmaps(calls.withColumn("unknown", F.col("var_type") == schema.UNKNOWN_TYPE), _SET)


def require_new(existing: DataFrame, samples: DataFrame, what: str) -> None:
    n = samples.select("sample_id").join(existing.select("sample_id").distinct(), "sample_id", "left_semi").limit(10).collect()
    if n:
        raise ExistsError(f"samples have {what} already: {', '.join(str(r[0]) for r in n)}")


_NOTES = "spdi string, sequence string, position int, deletion int, insertion string, var_type string, annotation string, impact string, gene_name string, gene_id string, hgvs_c string, hgvs_p string, id_hgvs_c string, id_hgvs_p string"
_TABLES = {
    "samples": schema.SAMPLES,
    "loads": schema.struct("sample_id long, kind string"),
    "calls": schema.struct("sample_id long, sequence string, position int, deletion int, insertion string, var_type string, spdi string, bin int"),
    "mlst": schema.MLST_CALLS,
    "masks": schema.MASKS,
    "reference_sequences": schema.REFERENCE_SEQUENCES,
    "kmer": schema.KMER_SKETCH,
    "annotations": schema.struct(_NOTES + ", bin int"),
    "sample_sets": schema.struct("spdi string, sequence string, position int, unknown boolean, word long, bits long, bin int"),
    "trees": schema.struct("reference_name string, newick string, alignment_length int"),
}
#: Folders of a table, and the order of rows within its files: what a lookup prunes and skips by.
_FOLDERS = {"calls": ["sequence", "bin"], "sample_sets": ["sequence", "bin"], "annotations": ["sequence", "bin"], "mlst": ["scheme"], "kmer": ["ksize"], "masks": ["sequence"], "loads": ["kind"]}
_SORTED = {"calls": ["position", "sample_id"], "sample_sets": ["position"], "annotations": ["position"], "mlst": ["locus", "allele"], "kmer": ["hash"], "masks": ["start0"]}
#: Words of bits repeat; other tables are written as the session says.
_CODEC = {"sample_sets": "zstd"}
#: What a sample set belongs to; its rows of several loads are united when they are read or compacted.
_SET = ("spdi", "sequence", "bin", "position", "unknown")
#: What makes a row of a table: enforced when rows are written, so that no reader deduplicates.
_KEYS = {"calls": ["sequence", "bin", "spdi", "sample_id"], "mlst": ["scheme", "sample_id", "locus", "allele"], "kmer": ["ksize", "sample_id", "hash"], "annotations": ["sequence", "bin", "spdi"], "masks": ["sequence", "sample_id", "start0", "end0"]}


class SampleIndex(IndexView):
    """Tables under one folder, addressed relative to it, so the folder can be moved.

    Rows are unique by key when they are written. Calls and annotations lie by sequence and position
    bin and are sorted by position within a file, so a lookup of a variant lists the folders of its
    bin and skips row groups by position; it neither scans nor shuffles the rest. A load first notes
    its samples in `loads`; one that broke off can only be repeated with allow_existing, which adds
    the rows that are missing.

    After `build_sets` the samples of each variant and unknown position are stored as bitmaps too. A load
    appends those of its own calls, which repeating it does not change, and counts and lists of samples
    are read from them, never from the calls.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _there(self, name: str) -> bool:
        files, path = self._files(self._path(name))
        return files.exists(path)

    def table(self, name: str) -> DataFrame:
        kind = _TABLES[name]
        if not self._there(name):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(self._path(name)).select([f.name for f in kind])

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows as they are; keys are the caller's business, see `add`."""
        if "bin" in _TABLES[name].names:
            rows = rows.withColumn("bin", F.floor(F.col("position") / schema.BIN))
        rows = rows.select([F.col(f.name).cast(f.dataType) for f in _TABLES[name]])
        folders = _FOLDERS.get(name, [])
        if folders:  # adaptive execution joins small folders' rows and splits those of a large one
            rows = rows.hint("rebalance", *[F.col(c) for c in folders]).sortWithinPartitions(*folders, *_SORTED.get(name, []))
        rows.write.mode("append").partitionBy(*folders).parquet(self._path(name), compression=_CODEC.get(name))

    def add(self, name: str, rows: DataFrame, known_new: bool = False) -> None:
        """Add the rows whose key is not there yet, one for each key. known_new: the caller knows that
        none is there, so only the new rows are compared with each other."""
        if "bin" in _TABLES[name].names:
            rows = rows.withColumn("bin", F.floor(F.col("position") / schema.BIN).cast("int"))
        rows = rows.select([F.col(f.name).cast(f.dataType) for f in _TABLES[name]])
        sets = name == "calls" and self.has_sets
        if sets or not known_new:
            rows = written(rows, name)
        existing = self.table(name).where(F.lit(False)) if known_new else self.touched(name, rows)
        self.append(name, fresh_rows(existing, rows, _KEYS[name]))
        if sets:  # of all rows, so that a load that broke off before this is made up for
            self.append("sample_sets", _call_sets(rows))

    def touched(self, name: str, rows: DataFrame) -> DataFrame:
        """What the table holds in the folders that the rows belong to."""
        folders = _FOLDERS.get(name, [])
        if not folders:
            return self.table(name)
        own = rows.select(*folders).distinct()
        listed = own.limit(MOST_FOLDERS + 1).collect()
        if len(listed) > MOST_FOLDERS:
            return self.table(name).join(own, folders, "left_semi")
        by_first: dict = {}
        for r in listed:
            by_first.setdefault(r[0], []).append(r[1:])
        which = F.lit(False)
        for first, rest in by_first.items():
            same = F.col(folders[0]).eqNullSafe(F.lit(first))
            which = which | (same & F.col(folders[1]).isin([r[0] for r in rest]) if len(folders) > 1 else same)
        return self.table(name).where(which)

    def compact(self, name: str) -> None:
        """Rewrite a table with few files a folder, in place of what many small loads have left. Nobody may load
        meanwhile; a run that breaks off leaves the old table, or both beside each other."""
        if self._there(name):
            self._replace(name, self.sets() if name == "sample_sets" else self.table(name))

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Write a table beside the old one, if there is one, and then put it in its place."""
        files, path = self._files(self._path(name))
        _, new = self._files(self._path(f"{name}-compacted"))
        _, old = self._files(self._path(f"{name}-replaced"))
        files.delete(new, True)
        folders = _FOLDERS.get(name, [])
        rows = rows.select(_TABLES[name].names).hint("rebalance", *[F.col(c) for c in folders]).sortWithinPartitions(*folders, *_SORTED.get(name, []))
        rows.write.partitionBy(*folders).parquet(new.toString(), compression=_CODEC.get(name))
        if files.exists(path):
            files.rename(path, old)
        files.rename(new, path)
        files.delete(old, True)

    # Sample sets.

    @property
    def has_sets(self) -> bool:
        return self._there("sample_sets")

    def build_sets(self) -> None:
        """Store the sample sets of all calls; built again, they are replaced. Nobody may load meanwhile. The
        table appears when it is whole, so a run that breaks off leaves none."""
        self._replace("sample_sets", _call_sets(self.table("calls")))

    def sets(self, which: Column | None = None) -> DataFrame:
        """The stored sample sets, or those a predicate over their columns holds of, united over loads."""
        rows = self.table("sample_sets")
        return bitmaps.union_bitmaps(rows if which is None else rows.where(which), by=_SET)

    def _variants_named(self, include_unknown: bool = False) -> DataFrame:
        if not self.has_sets:
            return super()._variants_named(include_unknown)
        rows = self.table("sample_sets")
        return (rows if include_unknown else rows.where("not unknown")).select("sequence", "spdi").distinct()

    def mutation_counts(self, reference_name: str | None = None, include_unknown: bool = False) -> DataFrame:
        if not self.has_sets:
            return super().mutation_counts(reference_name, include_unknown)
        sets = self.sets(None if include_unknown else ~F.col("unknown"))
        if reference_name is not None:
            sets = sets.join(self.references.where(F.col("reference_name") == reference_name), "sequence", "left_semi")
        return bitmaps.sizes(sets, ("spdi",))

    def _sets_of(self, variants: DataFrame) -> DataFrame:
        """(feature, word, bits) of variants (feature, sequence, position, deletion, insertion): the
        join prunes folders, and a variant that is asked for by several names is found for each."""
        spdi = ids.spdi_format(F.col("sequence"), F.col("position"), F.col("deletion"), F.col("insertion"))
        asked = variants.select("feature", "sequence", F.floor(F.col("position") / schema.BIN).cast("int").alias("bin"), "position", spdi.alias("spdi"))
        known = self.table("sample_sets").where("not unknown")
        return bitmaps.union_bitmaps(known.join(asked, ["sequence", "bin", "position", "spdi"]).select("feature", "word", "bits"))

    def variant_samples(self, variants: DataFrame) -> DataFrame:
        return bitmaps.from_bitmaps(self._sets_of(variants)) if self.has_sets else super().variant_samples(variants)

    def variant_sample_counts(self, variants: DataFrame) -> DataFrame:
        return bitmaps.sizes(self._sets_of(variants)) if self.has_sets else super().variant_sample_counts(variants)

    @property
    def samples(self) -> DataFrame:
        return self.table("samples")

    @property
    def calls(self) -> DataFrame:
        return self.table("calls")

    @property
    def mlst(self) -> DataFrame:
        return self.table("mlst")

    @property
    def masks(self) -> DataFrame:
        return self.table("masks")

    @property
    def sketch(self) -> DataFrame:
        return self.table("kmer")

    @property
    def annotations(self) -> DataFrame:
        """One row a variant; of several loads the first counts, and of one load the least row."""
        return self.table("annotations").drop("bin")

    @property
    def references(self) -> DataFrame:
        return self.table("reference_sequences").select("reference_name", F.col("sequence_name").alias("sequence"))

    @property
    def sequences(self) -> DataFrame:
        return self.table("reference_sequences").select(F.col("sequence_name").alias("sequence"), "length", F.col("sequence").alias("bases"))

    def bases_of(self, reference_name: str) -> DataFrame:
        t = self.table("reference_sequences").where(F.col("reference_name") == reference_name)
        return t.select(F.col("sequence_name").alias("sequence"), F.col("sequence").alias("bases"))

    @cached_property
    def query_all(self):
        from triloom.query import SamplesQuery

        return SamplesQuery.all(self)

    # Results on the driver.

    def sample_names(self) -> list[str]:
        return [r[0] for r in self.samples.select("sample_name").orderBy("sample_name").collect()]

    def reference_names(self) -> list[str]:
        return [r[0] for r in self.reference_table().orderBy("reference_name").collect()]

    def mlst_schemes(self) -> list[str]:
        return [r[0] for r in self.schemes().orderBy("scheme").collect()]

    def count_samples(self) -> int:
        return self.samples.count()

    def count_references(self) -> int:
        return self.reference_table().count()

    def count_mutations(self, reference_name: str, include_unknown: bool = False) -> int:
        return self.mutation_counts(reference_name, include_unknown).count()

    def sample_ids(self, names: list[str], ignore_missing: bool = False) -> DataFrame:
        """(sample_id, sample_name) of the names; unknown ones are an error that lists ten of them, unless ignored."""
        asked = self.spark.createDataFrame([(n,) for n in names], "sample_name string")
        if not ignore_missing:
            lost = [r[0] for r in self.missing_names(asked).orderBy("sample_name").limit(10).collect()]
            if lost:
                raise ValueError(f"no such samples: {', '.join(lost)}")
        return self.samples_named(asked)

    def _asked(self, features: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(f,) for f in features], "feature string")

    def find_samples_by_features(self, features: list[str]) -> dict[str, list[str]]:
        """Names of the samples that are found to have each feature: one plan for all variants and
        alleles; HGVS ids go by their query, as several variants may carry one."""
        from triloom.query import SamplesQuery

        named = [f for f in features if f.startswith(("hgvs:", "hgvs_gn:"))]
        rows = self.samples_of_features(self._asked([f for f in features if f not in named])).join(self.samples, "sample_id")
        found: dict[str, list[str]] = {f: SamplesQuery.all(self).hasa(f).tolist() if f in named else [] for f in features}
        for r in rows.orderBy("sample_name").collect():
            found[r["feature"]].append(r["sample_name"])
        return found

    def count_samples_by_features(self, features: list[str]) -> dict[str, int]:
        plain = [f for f in features if not f.startswith(("hgvs:", "hgvs_gn:"))]
        counts = {r["feature"]: r["n"] for r in self.feature_sample_counts(self._asked(plain)).collect()}
        return {f: counts[f] if f in counts else len(self.samples_query().hasa(f)) for f in features}

    def has_kmer_index(self, sample_name: str) -> bool:
        return not self.with_kmer_index().join(self.samples.where(F.col("sample_name") == sample_name), "sample_id", "left_semi").isEmpty()

    def spdi_with_bases(self, spdi: list[str]) -> dict[str, str]:
        """Ids with the deletion spelled out from the reference."""
        t = self.spark.createDataFrame([(x,) for x in spdi], "spdi string").select("spdi", ids.spdi_parse(ids.spdi_normalize(F.col("spdi"))).alias("p"))
        t = t.select("spdi", "p.*").join(self.sequences, "sequence")
        bases = F.substring("bases", F.col("position"), F.col("deletion").cast("int"))
        return {r[0]: r[1] for r in t.select("spdi", ids.spdi_format(F.col("sequence"), F.col("position"), bases, F.col("insertion"))).collect()}

    # Ingest.

    def _claim(self, names: DataFrame, kind: str, allow_existing: bool) -> DataFrame:
        """(sample_id, sample_name) of all names, new ones numbered and noted as loaded. Samples that
        have a load of the kind are an error before anything is written, unless allowed."""
        before = self.samples_named(names)
        loaded = self.table("loads").where(F.col("kind") == kind)
        if not allow_existing:
            require_new(loaded, before, kind)
        known = self.add_samples(names)
        self.append("loads", known.join(loaded, "sample_id", "left_anti").select("sample_id", F.lit(kind).alias("kind")))
        return known

    def add_samples(self, names: DataFrame) -> DataFrame:
        """Get or create: ids of all names."""
        fresh = new_samples(self.samples, names)
        if not fresh.isEmpty():
            self.append("samples", fresh)
        return self.samples_named(names)

    def add_reference(self, name: str, seqs: DataFrame) -> None:
        """seqs (sequence, bases)."""
        if not self.references.where(F.col("reference_name") == name).isEmpty():
            raise ExistsError(f"reference {name} exists")
        self.append("reference_sequences", seqs.select(F.lit(name).alias("reference_name"), F.col("sequence").alias("sequence_name"), F.length("bases").alias("length"), F.col("bases").alias("sequence")))

    def add_variants(self, variants: DataFrame, masks: DataFrame | None = None, allow_existing: bool = False, index_unknown: bool = True, names: DataFrame | None = None) -> None:
        """variants: VCF rows (sample, chrom, pos, ref, alt, type, annotation fields or none) of any
        number of samples; masks (sample, sequence, start0, end0). Masked positions become unknown
        calls and win over variants; without index_unknown they are kept as masks only. names
        (sample_name): samples that are there even if they have neither variant nor mask."""
        from triloom.operators import annotate, intervals

        variants = written(variants, "variants")  # files are parsed once a load
        if names is None:
            names = variants.select(F.col("sample").alias("sample_name"))
            if masks is not None:
                names = names.union(masks.select("sample"))
        known = self._claim(names, "variants", allow_existing)
        own = variants.join(known, variants["sample"] == known["sample_name"])
        calls = own.select(
            "sample_id", F.col("chrom").alias("sequence"), F.col("pos").alias("position"), F.length("ref").alias("deletion"), F.col("alt").alias("insertion"), F.col("type").alias("var_type")
        )
        if masks is not None:
            m = masks.join(known, masks["sample"] == known["sample_name"]).select("sample_id", "sequence", "start0", "end0")
            m = intervals.merge(m, ["sample_id", "sequence"])
            self.add("masks", m, not allow_existing)
            if index_unknown:
                calls = calls.unionByName(intervals.unknown_features(m).select(*calls.columns))
        calls = annotate.mask_precedence(calls, ["sample_id", "sequence", "position"], "insertion")
        calls = calls.withColumn("spdi", ids.spdi_format(F.col("sequence"), F.col("position"), F.col("deletion"), F.col("insertion")))
        self.add("calls", calls, not allow_existing)
        if "annotation" in variants.columns:
            s, g = F.col("chrom"), F.col("gene_id")
            spdi = ids.spdi_format(s, F.col("pos"), F.length("ref"), F.col("alt"))
            notes = variants.where("annotation is not null or hgvs_c is not null").select(
                spdi.alias("spdi"), s.alias("sequence"), F.col("pos").alias("position"), F.length("ref").alias("deletion"), F.col("alt").alias("insertion"), F.col("type").alias("var_type"), "annotation", "impact", "gene_name", "gene_id", "hgvs_c", "hgvs_p"
            )
            s = F.col("sequence")
            self.add("annotations", notes.withColumns({"id_hgvs_c": ids.hgvs_id(s, g, F.col("hgvs_c")), "id_hgvs_p": ids.hgvs_id(s, g, F.col("hgvs_p"))}))

    def add_mlst(self, rows: DataFrame, allow_existing: bool = False) -> None:
        """rows (sample, scheme, locus, allele) as the table readers give them."""
        known = self._claim(rows.select(F.col("sample").alias("sample_name")), "alleles", allow_existing)
        self.add("mlst", rows.join(known, rows["sample"] == known["sample_name"]).select("sample_id", "scheme", "locus", "allele"), not allow_existing)

    def add_sketches(self, rows: DataFrame) -> None:
        """rows (sample, ksize, hash); samples with a sketch are skipped."""
        names = rows.select(F.col("sample").alias("sample_name"))
        loaded = self.table("loads").where("kind = 'sketch'")
        fresh = names.distinct().join(self.samples.join(loaded, "sample_id", "left_semi"), "sample_name", "left_anti")
        known = self._claim(fresh, "sketch", True)
        self.add("kmer", rows.join(known, rows["sample"] == known["sample_name"]).select("sample_id", "ksize", "hash"), True)

    def update_tree(self, reference_name: str, newick: str, alignment_length: int) -> None:
        if alignment_length <= 0:
            raise ValueError("the alignment length must be above 0")
        rest = [tuple(r) for r in self.table("trees").where(F.col("reference_name") != reference_name).collect()]
        rows = self.spark.createDataFrame([*rest, (reference_name, newick, alignment_length)], _TABLES["trees"])
        rows.coalesce(1).write.mode("overwrite").parquet(self._path("trees"))

    def stored_tree(self, reference_name: str) -> tuple[str, int] | None:
        r = self.table("trees").where(F.col("reference_name") == reference_name).first()
        return (r["newick"], r["alignment_length"]) if r else None

    def rebuild_tree(self, reference_name: str, align_type: str = "full", include_variants: tuple[str, ...] | None = None) -> str:
        """Neighbour joining of the SNP distances of all samples on the reference, stored with it."""
        from triloom.operators import tree
        from triloom.query import SamplesQuery

        q = SamplesQuery.on_reference(self, reference_name).build_tree("mutation", reference_name=reference_name, align_type=align_type, include_variants=include_variants)
        newick = tree.to_newick(q.root)
        self.update_tree(reference_name, newick, q.alignment_length)
        return newick

    def sizes(self, unit: str = "B") -> DataFrame:
        """(part, size, files) of each table's folder and their total."""
        rows = []
        for name in _TABLES:
            if self._there(name):
                files, path = self._files(self._path(name))
                s = files.getContentSummary(path)
                rows.append((name, float(s.getLength()), int(s.getFileCount())))
        rows.append(("Total", sum(r[1] for r in rows), sum(r[2] for r in rows)))
        return self.spark.createDataFrame(rows, "part string, size double, files int").withColumn("size", ids.size_in_unit(F.col("size"), unit))


#: The project's settings, beside its data.
CONFIG = "triloom.json"


def _config(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{CONFIG}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def init_project(spark: SparkSession, root: str, data: str = "data") -> SampleIndex:
    """A new project folder: settings that name the data folder, relative to it. One that is there is an error."""
    files, path = _config(spark, root)
    if files.exists(path):
        raise ExistsError(f"{root} is a project already")
    write_text(spark, path.toString(), json.dumps({"format": 1, "data": data}), overwrite=False)
    return open_project(spark, root)


def open_project(spark: SparkSession, root: str) -> SampleIndex:
    """The index of a project folder, as its settings say."""
    files, path = _config(spark, root)
    if not files.exists(path):
        raise ValueError(f"{root} is no project: it has no {CONFIG}; run init first")
    config = json.loads("\n".join(r[0] for r in spark.read.text(path.toString()).collect()))
    if config.get("format") != 1 or not config.get("data"):
        raise ValueError(f"{root}/{CONFIG} is not understood: {config}")
    data = config["data"]
    return SampleIndex(spark, data if "://" in data or data.startswith("/") else f"{root.rstrip('/')}/{data}")
