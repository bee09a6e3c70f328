"""Lookups and counts over the domain tables, shared by the stored index and by any other source of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.functions import ids
from triloom.operators import features
from triloom.schema import UNKNOWN_ALLELE, UNKNOWN_TYPE


class IndexView:
    """What can be asked of samples, calls, mlst, references and sketch without a query.

    Every method plans a DataFrame and runs nothing. A subclass has the tables `samples (sample_id,
    sample_name)`, `calls`, `mlst`, `references (reference_name, sequence)`, `sequences`,
    `annotations` and `sketch (sample_id, ksize, hash)`.
    """

    samples: DataFrame
    calls: DataFrame
    mlst: DataFrame
    references: DataFrame
    sequences: DataFrame
    sketch: DataFrame

    # Samples.

    def samples_named(self, names: DataFrame) -> DataFrame:
        """(sample_id, sample_name) of those of the names (sample_name) that are there."""
        return self.samples.join(names.select("sample_name").distinct(), "sample_name", "left_semi").select("sample_id", "sample_name")

    def missing_names(self, names: DataFrame) -> DataFrame:
        """(sample_name) of the names that are not there."""
        return names.select("sample_name").distinct().join(self.samples, "sample_name", "left_anti")

    def samples_by_ids(self, sample_ids: DataFrame) -> DataFrame:
        return self.samples.join(sample_ids.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", "sample_name")

    def samples_other_than(self, chosen: DataFrame) -> DataFrame:
        """(sample_id, sample_name) of all samples but the chosen (sample_id)."""
        return self.samples.join(chosen.select("sample_id"), "sample_id", "left_anti").select("sample_id", "sample_name")

    def exists(self, sample_id: int) -> DataFrame:
        """One row: is there a sample of that id, and has it a sketch?"""
        here = self.samples.where(F.col("sample_id") == sample_id).agg((F.count("*") > 0).alias("sample_exists"))
        return here.crossJoin(self.sketch.where(F.col("sample_id") == sample_id).agg((F.count("*") > 0).alias("has_kmer_index")))  # one row each

    def with_kmer_index(self) -> DataFrame:
        return self.sketch.select("sample_id").distinct()

    def with_calls(self) -> DataFrame:
        """(sample_id) of the samples with a call, known or not: what a second load is refused for."""
        return self.calls.select("sample_id").distinct()

    # References and sequences.

    def reference_table(self) -> DataFrame:
        return self.references.select("reference_name").distinct()

    def reference_of(self, sequence: str) -> DataFrame:
        return self.references.where(F.col("sequence") == sequence).select("reference_name").distinct()

    def bases_of(self, reference_name: str) -> DataFrame:
        """(sequence, bases) of a reference."""
        return self.sequences.join(self.references.where(F.col("reference_name") == reference_name), "sequence", "left_semi").select("sequence", "bases")

    def on_reference(self, reference_name: str) -> DataFrame:
        """The calls on the sequences of a reference."""
        return self.calls.join(self.references.where(F.col("reference_name") == reference_name), "sequence", "left_semi")

    def on_sequence(self, sequence: str) -> DataFrame:
        """(sample_id) of the samples with a call on the sequence."""
        return self.calls.where(F.col("sequence") == sequence).select("sample_id").distinct()

    def reference_samples(self) -> DataFrame:
        """(reference_name, sample_id): samples with a call on each reference. Calls meet by sequence
        before the join, so it is over samples times sequences."""
        return self.calls.select("sequence", "sample_id").distinct().join(self.references, "sequence").select("reference_name", "sample_id").distinct()

    def sample_references(self) -> DataFrame:
        """(sample_id, sample_name, reference_name) of the same."""
        return self.reference_samples().join(self.samples, "sample_id").select("sample_id", "sample_name", "reference_name")

    # Variants.

    def _known(self, include_unknown: bool = False) -> DataFrame:
        return self.calls if include_unknown else self.calls.where(F.col("var_type") != UNKNOWN_TYPE)

    def _variants_named(self, include_unknown: bool = False) -> DataFrame:
        """(sequence, spdi) of all variants."""
        return self._known(include_unknown).select("sequence", "spdi").distinct()

    def mutation_counts(self, reference_name: str | None = None, include_unknown: bool = False) -> DataFrame:
        """(spdi, n): samples of each variant, of one reference or all."""
        calls = self._known(include_unknown)
        if reference_name is not None:
            calls = calls.join(self.references.where(F.col("reference_name") == reference_name), "sequence", "left_semi")
        return calls.groupBy("spdi").agg(F.count("*").alias("n"))

    def mutation_counts_in(self, chosen: DataFrame, var_type: str | None = None) -> DataFrame:
        """(spdi, n) over the chosen samples (sample_id), of one type or all."""
        calls = self._known() if var_type is None else self.calls.where(F.col("var_type") == var_type)
        return calls.join(chosen.select("sample_id"), "sample_id", "left_semi").groupBy("spdi").agg(F.count("*").alias("n"))

    def reference_mutations(self, include_unknown: bool = False) -> DataFrame:
        """(reference_name, n): distinct variants on each reference."""
        v = self._variants_named(include_unknown)
        return v.join(self.references, "sequence").groupBy("reference_name").agg(F.count_distinct("spdi").alias("n"))

    def variants_on_reference(self, reference_name: str) -> DataFrame:
        """(spdi, is_unknown) of the variants and unknown positions on a reference."""
        return self.on_reference(reference_name).select("spdi", (F.col("var_type") == UNKNOWN_TYPE).alias("is_unknown")).distinct()

    def variants_in_order(self, sequence: str, var_type: str | None = None) -> DataFrame:
        """(position, spdi) along a sequence."""
        v = self._known().where(F.col("sequence") == sequence)
        v = v if var_type is None else v.where(F.col("var_type") == var_type)
        return v.select("position", "spdi").distinct().orderBy("position", "spdi")

    def variant_union(self, chosen: DataFrame | None = None) -> DataFrame:
        """(chrom, pos, ref, alt, n): the variants of the chosen samples (or all) with their number of samples."""
        c = self._known() if chosen is None else self._known().join(chosen.select("sample_id"), "sample_id", "left_semi")
        return c.groupBy(F.col("sequence").alias("chrom"), F.col("position").alias("pos"), F.col("deletion").alias("ref"), F.col("insertion").alias("alt")).agg(F.count("*").alias("n"))

    def calls_of(self, features_: list[str]) -> DataFrame:
        """The calls of the variants in a list of SPDIs."""
        return self.calls.where(self._among(features_))

    @staticmethod
    def _among(features_: list[str]) -> Column:
        """spdi in the list; sequence and position too, so that files of others are not read."""
        parts = [ids.parse_feature(f) for f in features_]
        return F.col("spdi").isin([f"{p.sequence}:{p.position}:{p.deletion}:{p.insertion}" for p in parts]) & F.col("sequence").isin([p.sequence for p in parts]) & F.col("position").isin([p.position for p in parts])

    # Counts.

    def totals(self) -> DataFrame:
        """One row: samples, references and mutations."""
        n = self.samples.agg(F.count("*").alias("samples"))
        r = self.references.agg(F.count_distinct("reference_name").alias("refs"))
        return n.crossJoin(r).crossJoin(self._variants_named().agg(F.count_distinct("spdi").alias("mutations")))  # one row each

    def reference_sample_counts(self) -> DataFrame:
        return self.reference_samples().groupBy("reference_name").agg(F.count("*").alias("n"))

    def scheme_sample_counts(self) -> DataFrame:
        return self.mlst.groupBy("scheme").agg(F.count_distinct("sample_id").alias("n"))

    @staticmethod
    def _variants_asked(asked: DataFrame) -> DataFrame:
        """(feature, sequence, position, deletion, insertion) of the SPDIs, with deleted bases or their number, in a table (feature)."""
        f = asked.select("feature").distinct().where(ids.feature_kind(F.col("feature")) == "spdi")
        f = f.select("feature", ids.spdi_parse(ids.spdi_normalize(F.col("feature"))).alias("p"))
        return f.select("feature", F.col("p.sequence").alias("sequence"), F.col("p.position").cast("int").alias("position"), F.col("p.deletion").cast("int").alias("deletion"), F.col("p.insertion").alias("insertion"))

    def variant_samples(self, variants: DataFrame) -> DataFrame:
        """(feature, sample_id) of variants (feature, sequence, position, deletion, insertion) and the samples that have them."""
        return self._known().join(variants, ["sequence", "position", "deletion", "insertion"]).select("feature", "sample_id").distinct()

    def variant_sample_counts(self, variants: DataFrame) -> DataFrame:
        """(feature, n) of those that a sample has."""
        return self.variant_samples(variants).groupBy("feature").agg(F.count("*").alias("n"))

    def _allele_samples(self, asked: DataFrame) -> DataFrame:
        """(feature, sample_id) of the alleles in a table (feature)."""
        alleles = self.mlst.where(F.col("allele") != UNKNOWN_ALLELE).select(ids.mlst_id(F.col("scheme"), F.col("locus"), F.col("allele")).alias("feature"), "sample_id")
        return alleles.join(asked.select("feature").where(ids.feature_kind(F.col("feature")) == "mlst"), "feature", "left_semi").distinct()

    def samples_of_features(self, asked: DataFrame) -> DataFrame:
        """(feature, sample_id) of the samples found to have each feature of a table (feature): variants
        and alleles, in one join each."""
        return self.variant_samples(self._variants_asked(asked)).union(self._allele_samples(asked))

    def feature_sample_counts(self, asked: DataFrame) -> DataFrame:
        """(feature, n) of each feature of a table, 0 where no sample has it."""
        counts = self.variant_sample_counts(self._variants_asked(asked)).union(self._allele_samples(asked).groupBy("feature").agg(F.count("*").alias("n")))
        return asked.select("feature").distinct().join(counts, "feature", "left").select("feature", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

    def feature_sample_lists(self, asked: DataFrame) -> DataFrame:
        """(feature, samples): the sorted sample ids, as many features as are asked for."""
        return self.samples_of_features(asked).groupBy("feature").agg(F.sort_array(F.collect_list("sample_id")).alias("samples"))

    # Alleles.

    def with_scheme(self, scheme: str) -> DataFrame:
        """(sample_id) of the samples with an allele of the scheme."""
        return self.mlst.where(F.col("scheme") == scheme).select("sample_id").distinct()

    def schemes(self) -> DataFrame:
        return self.mlst.select("scheme").distinct()

    def scheme_loci(self) -> DataFrame:
        """(scheme, loci): loci of each scheme."""
        return self.mlst.groupBy("scheme").agg(F.count_distinct("locus").alias("loci"))

    def loci_alleles(self, scheme: str) -> DataFrame:
        return self.mlst.where(F.col("scheme") == scheme).select("locus", "allele").distinct()

    def alleles(self, scheme: str, locus: str) -> DataFrame:
        return self.mlst.where((F.col("scheme") == scheme) & (F.col("locus") == locus)).select("allele").distinct()

    def several_schemes(self) -> DataFrame:
        """(sample_id, schemes) of the samples that a loader of a single scheme refuses."""
        return self.mlst.groupBy("sample_id").agg(F.count_distinct("scheme").alias("schemes")).where("schemes > 1")

    def mlst_table(self, scheme: str | None = None, locus: str | None = None, include_unknown: bool = False) -> DataFrame:
        return features.mlst_features(self.mlst, include_unknown=include_unknown, scheme=scheme, locus=locus)

    # Summaries of the whole index.

    def samples_query(self, universe: str = "all", reference_name: str | None = None, data_frame: DataFrame | None = None, sample_ids_column: str | None = None, sample_names_column: str | None = None):
        """A query over all samples, those on a reference ('mutations') or those of a frame ('dataframe')."""
        from triloom.query import SamplesQuery

        if universe == "all":
            return SamplesQuery.all(self)
        if universe == "mutations":
            return SamplesQuery.on_reference(self, reference_name)
        if universe == "dataframe":
            return SamplesQuery.all(self).join(data_frame, sample_ids_column, sample_names_column)
        raise ValueError(f"unknown universe {universe}")

    def mutations_summary(self, reference_name: str, **which) -> DataFrame:
        """Of the samples on the reference; features of other references are not filtered out, as in the original."""
        return self.samples_query("mutations", reference_name).features_summary("mutations", **which)

    def mlst_summary(self, scheme: str | None = None, locus: str | None = None, **which) -> DataFrame:
        """Of all samples, or of those with the scheme where one is given."""
        query = self.samples_query()
        if scheme:
            query = query.set_universe(self.with_scheme(scheme))
        return query.features_summary("mlst", scheme=scheme, locus=locus, **which)

    def features_summary(self, kind: str = "mutations", scope: str | None = None, **which) -> DataFrame:
        if kind in ("mutations", "mutation"):
            return self.mutations_summary(scope, **which)
        if kind == "mlst":
            return self.mlst_summary(scope, **which)
        raise ValueError(f"unknown kind {kind}")

