"""The fluent query: an immutable selection of samples with three-valued statuses.

Every step builds a lazy plan; nothing runs before a result is asked for. One class holds the state
and, optionally, joined metadata and a tree, so the order of joins decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.functions import ids
from triloom.operators import cluster, features, kmer, linkage, lookup, paths, state, tree, typing
from triloom.schema import ABSENT, PRESENT, UNKNOWN
from triloom.session import written


#: Values of a metadata column that a comparison makes columns of, and leaves of a tree that is built by
#: neighbour joining: its distances are a square on the driver. More are an error.
MOST_CATEGORIES, MOST_LEAVES = 1000, 10_000


class Later:
    """A table or tree that is made when something of it is asked for, once."""

    def __init__(self, make: Callable[[], Any]):
        self._make = make

    def made(self) -> Any:
        if self._make is not None:
            self._value, self._make = self._make(), None
        return self._value

    def __getattr__(self, name: str) -> Any:
        return getattr(self.made(), name)


def made(x: Any) -> Any:
    return x.made() if isinstance(x, Later) else x


def _quoted(column: str) -> str:
    """A column's name as a reference to it, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


@dataclass(frozen=True)
class SamplesQuery:
    db: Any  # has samples, calls, mlst, annotations, sketch
    state: DataFrame
    steps: tuple[str, ...] = ()
    metadata: DataFrame | None = None
    ids_column: str | None = None  # which metadata column the ids came from
    nodes: DataFrame | None = None
    root: tree.Node | None = None
    alignment_length: int = 1
    reference_leaf: str | None = None
    default_kind: str = "sample"
    default_column: str | None = None
    typers: dict[str, Callable] = field(default_factory=dict)

    @staticmethod
    def all(db: Any) -> SamplesQuery:
        return SamplesQuery(db, state.everything(db.samples))

    @staticmethod
    def on_reference(db: Any, reference_name: str) -> SamplesQuery:
        """Samples with a variant call on the reference; its stored tree is attached if there is one."""
        on = db.calls.join(db.references.where(F.col("reference_name") == reference_name), "sequence", "left_semi").select("sample_id").distinct()
        query = SamplesQuery(db, state.everything(on), (f"mutations({reference_name})",))
        stored = getattr(db, "stored_tree", lambda _: None)(reference_name)
        return query if stored is None else query.join_tree(stored[0], stored[1], reference_name)

    def _next(self, new: DataFrame, step: str, **more) -> SamplesQuery:
        return replace(self, state=new, steps=(*self.steps, step), **more)

    # Set algebra.

    def and_(self, other: SamplesQuery) -> SamplesQuery:
        return self._next(state.and_(self.state, other.state), f"AND({other.query_expression()})")

    def or_(self, other: SamplesQuery) -> SamplesQuery:
        return self._next(state.or_(self.state, other.state), f"OR({other.query_expression()})")

    def complement(self) -> SamplesQuery:
        return self._next(state.not_(self.state), "complement")

    __and__, __or__, __invert__ = and_, or_, complement

    def select_present(self) -> SamplesQuery:
        return self._next(state.select(self.state, PRESENT), "select_present")

    def select_absent(self) -> SamplesQuery:
        return self._next(state.select(self.state, ABSENT), "select_absent")

    def select_unknown(self) -> SamplesQuery:
        return self._next(state.select(self.state, UNKNOWN), "select_unknown")

    def reset_universe(self, include_unknown: bool = True) -> SamplesQuery:
        return self._next(state.reset_universe(self.state, include_unknown), "reset_universe")

    def set_universe(self, universe: DataFrame | None) -> SamplesQuery:
        return self._next(state.set_universe(self.state, universe), "set_universe")

    def intersect(self, chosen: DataFrame, message: str = "intersect") -> SamplesQuery:
        return self._next(state.restrict(self.state, chosen), message)

    def subsample(self, k: float, include_unknown: bool = False, seed: int = 0) -> SamplesQuery:
        return self._next(state.subsample(self.state, k, include_unknown, seed), f"subsample(k={k}, seed={seed})")

    # Predicates.

    def hasa(self, feature: str | list[str], kind: str = "mutation") -> SamplesQuery:
        """Samples with a feature, or with all features of a list; of SPDIs in a single scan of the calls."""
        listed = [feature] if isinstance(feature, str) else list(feature)
        if not listed:
            return self
        if ids.same_class(listed) is ids.Spdi:
            new = state.and_status(self.state, lookup.spdi_list_status(self.db.calls, [ids.parse_feature(f) for f in listed]))
        else:
            new = self.state
            for f in map(ids.parse_feature, listed):
                new = state.and_status(new, self.feature_status(f))
        return self._next(new, " AND ".join(f"hasa('{f}')" for f in listed))

    has = hasa

    def feature_status(self, f) -> DataFrame:
        if isinstance(f, ids.Mlst):
            return lookup.mlst_status(self.db.mlst, f)
        if isinstance(f, ids.Hgvs):
            return lookup.hgvs_status(self.db.calls, self.db.annotations, f)
        if isinstance(f, ids.HgvsGn):
            return lookup.hgvs_gn_status(self.db.calls, self.db.annotations, f)
        return lookup.spdi_status(self.db.calls, f)

    def _ids(self, data: Any) -> DataFrame:
        if isinstance(data, SamplesQuery):
            return data.state.where(F.col("status") == PRESENT).select("sample_id")
        if isinstance(data, DataFrame):
            return data.select("sample_id")
        names = [data] if isinstance(data, str) else list(data)
        return self.db.samples.where(F.col("sample_name").isin(names)).select("sample_id")

    def isa(self, data: Any, kind: str | None = None, column: str | None = None, regex: bool = False) -> SamplesQuery:
        """By sample name(s), query or ids; by metadata value (kind='dataframe'); or by a registered typer."""
        kind = kind or self.default_kind
        if kind in ("sample", "samples", "names"):
            return self._next(state.restrict(self.state, self._ids(data)), f"isa({data if isinstance(data, str) else type(data).__name__})")
        if kind == "dataframe":
            if self.metadata is None:
                raise ValueError("no metadata is joined")
            c = F.col(_quoted(column or self.default_column))
            hit = F.coalesce(c.cast("string").rlike(data), F.lit(False)) if regex else c == data
            return self._next(state.restrict(self.state, self.metadata.where(hit)), f"isa('{data}', column='{column or self.default_column}', regex={regex})")
        if kind in self.typers:
            return self.typers[kind](data, self)
        raise ValueError(f"unknown kind {kind}")

    isan = isa

    def isin(self, data: Any, kind: str = "samples", distance: float | None = None, units: str = "kmer_jaccard", kmer_size: int = 31) -> SamplesQuery:
        if kind in ("sample", "samples"):
            return self._next(state.restrict(self.state, self._ids(data)), "isin(samples)")
        if kind == "dataframe":
            if not isinstance(data, Column) or self.metadata is None:
                raise ValueError("kind='dataframe' takes a boolean Column over joined metadata")
            return self._next(state.restrict(self.state, self.metadata.where(data)), "isin(dataframe)")
        if kind == "mrca":
            names = self._names(data)
            top = tree.mrca(self._tree(), names)
            return self._next(state.restrict(self.state, self._by_name(tree.leaves_below(self._tree(), top))), "isin(mrca)")
        if kind == "distance":
            if units == "kmer_jaccard":
                near = kmer.within(self._sketch(kmer_size), self._ids(data), distance)
            elif units in ("substitutions", "substitutions/site"):
                names = self._names(data)
                lost = names.join(self._tree().where("is_leaf").select("name"), "name", "left_anti").count()
                if lost:
                    raise ValueError(f"{lost} samples are not in the tree")
                factor = float(self.alignment_length) if units == "substitutions" else 1.0
                near = self._by_name(paths.least_distances(self._tree(), names).where(F.col("distance") * factor <= distance))
            else:
                raise ValueError(f"unknown units {units}")
            return self._next(state.restrict(self.state, near), f"within({distance} {units})")
        raise ValueError(f"unknown kind {kind}")

    def within(self, data: Any, distance: float | None = None, units: str | None = None, **more) -> SamplesQuery:
        units = units or ("substitutions/site" if self.nodes is not None else "kmer_jaccard")
        return self.isin(data, kind="mrca" if units == "mrca" else "distance", distance=distance, units=units, **more)

    def _tree(self) -> DataFrame:
        if self.nodes is None:
            raise ValueError("no tree is joined")
        return made(self.nodes)

    def _root(self) -> tree.Node:
        if self.root is None:
            return tree.from_nodes(self._tree())
        return made(self.root)

    def _names(self, data: Any) -> DataFrame:
        return self.db.samples.join(self._ids(data), "sample_id", "left_semi").select(F.col("sample_name").alias("name"))

    def _by_name(self, names: DataFrame) -> DataFrame:
        return self.db.samples.join(names.select(F.col("name").alias("sample_name")), "sample_name", "left_semi")

    # Joins.

    def join(self, frame: DataFrame, sample_ids_column: str | None = None, sample_names_column: str | None = None, default_isa_kind: str = "sample", default_isa_column: str | None = None) -> SamplesQuery:
        """Attach metadata by id or name; the universe keeps the samples that the frame has. Columns keep
        their names here; results show one that has a name of theirs as `<name>_metadata`."""
        if self.metadata is not None:
            raise ValueError("metadata is joined already")
        if (sample_ids_column is None) == (sample_names_column is None):
            raise ValueError("name either the ids' or the names' column")
        if any(c.lower() == "sample_id" != (sample_ids_column or "").lower() for c in frame.columns):
            raise ValueError("a column sample_id is in the way")
        if sample_ids_column:
            meta = frame.withColumn("sample_id", frame[_quoted(sample_ids_column)].cast("long"))
        else:
            names = self.db.samples.select("sample_id", F.col("sample_name").alias("_joined_name"))
            meta = frame.join(names, frame[_quoted(sample_names_column)] == F.col("_joined_name")).drop("_joined_name")
        kept = self.state.join(meta.select("sample_id"), "sample_id", "left_semi")
        return self._next(kept, "join(dataframe)", metadata=meta, ids_column=sample_ids_column, default_kind=default_isa_kind, default_column=default_isa_column)

    def _metadata_beside(self, taken: list[str], without: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
        """The metadata with its key as _key, columns with a taken name under another one, and its columns."""
        used, renamed = {c.lower() for c in taken}, []
        for c in self.metadata.columns:
            if c.lower() == "sample_id" or c in without:
                continue
            new = c
            while new.lower() in used:
                new += "_metadata"
            used.add(new.lower())
            renamed.append(F.col(_quoted(c)).alias(new))
        meta = self.metadata.select(F.col("sample_id").alias("_key"), *renamed)
        return meta, meta.columns[1:]

    def join_tree(self, newick: str | tree.Node, alignment_length: int = 1, reference_leaf: str | None = None) -> SamplesQuery:
        """Attach a tree: samples outside it become absent, the universe stays."""
        root = tree.parse_newick(newick) if isinstance(newick, str) else newick
        spark = self.state.sparkSession
        nodes = tree.tree_nodes(spark, root)
        leaves = nodes.where("is_leaf")
        if reference_leaf:
            nodes = nodes.where(~(F.col("is_leaf") & (F.col("name") == reference_leaf)))
        return self._next(state.restrict(self.state, self._by_name(leaves.select("name"))), "join_tree", nodes=nodes, root=root, alignment_length=alignment_length, reference_leaf=reference_leaf)

    def join_nodes(self, nodes: DataFrame, alignment_length: int = 1) -> SamplesQuery:
        """Attach a tree that is a nested-set table already."""
        return self._next(state.restrict(self.state, self._by_name(nodes.where("is_leaf").select("name"))), "join_tree", nodes=nodes, alignment_length=alignment_length)

    def _leaf_limit(self, chosen: DataFrame) -> None:
        if chosen.limit(MOST_LEAVES + 1).count() > MOST_LEAVES:
            raise ValueError(f"trees are built of at most {MOST_LEAVES} samples; subsample() first")

    def alignment(self, reference_name: str | None = None, align_type: str = "full", include_variants: tuple[str, ...] | None = None, include_reference: bool = True) -> DataFrame:
        """(record_id, alignment) of the present samples on a reference (the only one, if it is not
        named): SNPs at core positions, or the whole sequences. Masked positions are N, or no core."""
        from triloom.operators import align

        if align_type not in ("core", "full"):
            raise ValueError(f"unknown align type {align_type}")
        reference_name, own, samples, refs, masks = self._aligned(reference_name)
        label = reference_name if include_reference else None
        if align_type == "core":
            if include_variants not in (None, ("SNP",), ["SNP"]):
                raise ValueError("a core alignment is of SNPs only")
            return align.core_alignment(own, samples, refs, masks, label)
        return align.full_alignment(own, samples, refs, masks, label, tuple(include_variants or align.VARIANTS))

    def _aligned(self, reference_name: str | None) -> tuple:
        """(reference name, calls, samples, references, masks) that an alignment of the present samples is made of."""
        if reference_name is None:
            names = [r[0] for r in self.db.reference_table().limit(2).collect()]
            if len(names) != 1:
                raise ValueError("name the reference: there is none or more than one")
            reference_name = names[0]
        chosen = self._selected()
        samples = self.db.samples.join(chosen, "sample_id", "left_semi")
        refs = self.db.bases_of(reference_name)
        here = refs.select("sequence")
        own = self.db.calls.join(chosen, "sample_id", "left_semi").join(here, "sequence", "left_semi")
        masks = self.db.masks.join(chosen, "sample_id", "left_semi").join(here, "sequence", "left_semi")
        return reference_name, own, samples, refs, masks

    def snp_distance_pairs(self, reference_name: str | None = None) -> DataFrame:
        """(a, b, distance): the SNP distances of the present samples' core alignment, found from their calls."""
        from triloom.operators import align

        return align.core_snp_distances(*self._aligned(reference_name)[1:])

    def distance_pairs(self, kmer_size: int = 31) -> DataFrame:
        """(sample_a, sample_b, distance): what to_distances() holds below distance 1, as a table that never comes
        to the driver; a sample without sketch is an error."""
        return kmer.similar_pairs(self._own_sketch(kmer_size)[0])

    def _own_sketch(self, kmer_size: int) -> tuple[DataFrame, DataFrame]:
        """The present samples' sketch and themselves, both stored, as either is read several times."""
        chosen = written(self._selected(), "chosen")
        own = written(self._sketch(kmer_size).join(chosen, "sample_id", "left_semi"), "own")
        if (gone := kmer.missing_sketches(own, chosen).count()) > 0:
            raise ValueError(f"{gone} samples have no sketch")
        return own, chosen

    def linkage(self, kmer_size: int = 31) -> DataFrame:
        """(sample_a, sample_b, distance): the edges along which single linkage of k-mer distances joins the
        present samples, found without a square of distances; a sample without sketch is an error."""
        own, chosen = self._own_sketch(kmer_size)
        return linkage.spanning_edges(kmer.spanning_pairs(own), chosen)

    def build_tree(self, kind: str = "kmer", kmer_size: int = 31, reference_name: str | None = None, align_type: str = "full", include_variants: tuple[str, ...] | None = None, include_reference: bool = True) -> SamplesQuery:
        """A tree of the present samples: single linkage of k-mer distances, or neighbour joining of SNP
        distances of the alignment (no maximum-likelihood tree is claimed). kind
        'mutation_experimental' gives an experimental query of the same tree."""
        chosen = self._selected()
        if kind == "kmer":
            edges = self.linkage(kmer_size).select("sample_a", "sample_b", "distance").collect()  # one fewer than samples
            names = self.db.samples.join(chosen, "sample_id", "left_semi").orderBy("sample_id").collect()
            at = {r["sample_id"]: i for i, r in enumerate(names)}
            return self.join_tree(tree.dendrogram([r["sample_name"] for r in names], [(e["distance"], at[e["sample_a"]], at[e["sample_b"]]) for e in edges]))
        self._leaf_limit(chosen)
        if kind in ("mutation", "mutation_experimental"):
            from triloom.operators import align

            rows = self.alignment(reference_name, align_type, include_variants, include_reference)
            labels, length, m = align.distance_matrix(rows)
            if reference_name is None and include_reference:
                reference_name = self.db.reference_table().first()[0]
            out = self.join_tree(tree.neighbour_joining(labels, m / max(1, length)), max(1, length), reference_name if include_reference else None)
            return out.experimental() if kind == "mutation_experimental" else out
        raise ValueError(f"unknown kind {kind}")

    def experimental(self) -> SamplesQuery:
        """The same query with a tree that follows it: after each step the tree is that of the universe,
        pruned to the present samples."""
        if self.nodes is None:
            raise ValueError("no tree is joined")
        whole = self.nodes if self.root is None else tree.tree_nodes(self.state.sparkSession, self._root())
        return ExperimentalTreeQuery(**{f.name: getattr(self, f.name) for f in fields(self)}, universe_nodes=whole)

    def label_internal(self, label: Callable[[list[str]], str] = lambda names: "{" + ", ".join(names) + "}") -> tree.Node:
        """The tree with inner nodes named by a function of the sorted leaf names below each."""
        return tree.label_internal(self._root(), label)

    def prune(self, include_present: bool = True, include_unknown: bool = False, include_absent: bool = False) -> tree.Node | None:
        keep = {*self.tolist(True, include_present, include_unknown, include_absent), *([self.reference_leaf] if self.reference_leaf else [])}
        return tree.prune(self._root(), keep)

    def pruned_nodes(self, include_present: bool = True, include_unknown: bool = False, include_absent: bool = False) -> DataFrame:
        """The table of the tree of the samples of some classes (and the reference)."""
        names = self.db.samples.join(self._classes(include_present, include_unknown, include_absent), "sample_id", "left_semi").select(F.col("sample_name").alias("name"))
        return paths.pruned(self._tree(), names)

    def set_outgroup(self, name: str) -> SamplesQuery:
        return self.join_tree(tree.set_outgroup(self._root(), name), self.alignment_length, self.reference_leaf)

    def relabel_samples(self, rename: Callable[[str], str]) -> tree.Node:
        return tree.relabel(self._root(), rename)

    # Results.

    def query_expression(self) -> str:
        return " AND ".join(self.steps)

    def _classes(self, include_present: bool, include_unknown: bool, include_absent: bool) -> DataFrame:
        return self.state.where(F.col("status").isin([s for s, on in ((PRESENT, include_present), (UNKNOWN, include_unknown), (ABSENT, include_absent)) if on] or [-1]))

    def toframe(self, include_present: bool = True, include_unknown: bool = False, include_absent: bool = False) -> DataFrame:
        rows = self._classes(include_present, include_unknown, include_absent).join(self.db.samples, "sample_id")
        out = rows.select(F.lit(self.query_expression()).alias("Query"), F.col("sample_name").alias("Sample Name"), F.col("sample_id").alias("Sample ID"), ids.status_label(F.col("status")).alias("Status"))
        if self.metadata is not None:
            meta, more = self._metadata_beside(out.columns, tuple(c for c in self.metadata.columns if c == self.ids_column))
            out = out.join(meta, out["Sample ID"] == meta["_key"]).select(*[F.col(_quoted(c)) for c in (*out.columns, *more)])
        return out

    def tolist(self, names: bool = True, include_present: bool = True, include_unknown: bool = False, include_absent: bool = False) -> list:
        rows = self._classes(include_present, include_unknown, include_absent).join(self.db.samples, "sample_id")
        column = "sample_name" if names else "sample_id"
        return [r[0] for r in rows.select(column).orderBy(column).collect()]

    def toset(self, names: bool = True, **which) -> set:
        return set(self.tolist(names, **which))

    def summary(self) -> DataFrame:
        return state.counts(self.state, self.query_expression())

    def is_empty(self, include_unknown: bool = False) -> bool:
        return state.reset_universe(self.state, include_unknown).isEmpty()

    def __len__(self) -> int:
        return self.state.where(F.col("status") == PRESENT).count()

    def __str__(self) -> str:
        r = self.summary().first()
        share = lambda x: "NA" if x is None else f"{x:.0f}%"
        return f"<SamplesQuery[selected={share(r['percent_present'])} ({r['present']}/{r['total']}) samples, unknown={share(r['percent_unknown'])} ({r['unknown']}/{r['total']}) samples]>"

    def _selected(self) -> DataFrame:
        return self.state.where(F.col("status") == PRESENT).select("sample_id")

    def _table(self, kind: str, include_present: bool, include_unknown: bool, **which) -> tuple[DataFrame, list[str]]:
        if kind in ("mutations", "mutation"):
            return features.variant_features(self.db.calls.withColumnRenamed("spdi", "feature"), include_present, include_unknown), features.MUTATION_COLUMNS
        if kind == "mlst":
            f = self.db.mlst.withColumn("feature", ids.mlst_id(F.col("scheme"), F.col("locus"), F.col("allele")))
            return features.mlst_features(f, include_present, include_unknown, **which), features.MLST_COLUMNS
        raise ValueError(f"unknown kind {kind}")

    def _unknowns(self, kind: str, table: DataFrame) -> DataFrame:
        if kind == "mlst":
            bad = self.db.mlst.where("allele = '?'").select("scheme", "locus", "sample_id")
            return table.where("allele <> '?'").select("feature", "scheme", "locus").distinct().join(bad, ["scheme", "locus"]).select("feature", "sample_id")
        return lookup.unknown_pairs(self.db.calls, table.where("insertion <> '?'").select("feature", "sequence", "position", "deletion").distinct())

    def features_summary(self, kind: str = "mutations", selection: str = "all", include_present_features: bool = True, include_unknown_features: bool = False, include_unknown_samples: bool = False, include_unknown_no_present_samples: bool = False, ignore_annotations: bool = True, **which) -> DataFrame:
        table, columns = self._table(kind, include_present_features, include_unknown_features, **which)
        unknown = self._unknowns(kind, table) if include_unknown_samples else None
        chosen = self._selected()
        total = chosen.agg(F.count("*")).scalar()  # a subquery: nothing runs while this is planned
        out = features.summary(table, columns, chosen, total, unknown, include_unknown_no_present_samples)
        if selection == "unique":
            rest = self.state.where(F.col("status") != PRESENT).select("sample_id")
            out = features.unique_summary(out, features.summary(table, columns, rest, F.lit(1)))
        elif selection != "all":
            raise ValueError(f"unknown selection {selection}")
        if kind != "mlst" and not ignore_annotations:
            notes = ["annotation", "impact", "gene_name", "gene_id", "hgvs_c", "hgvs_p", "id_hgvs_c", "id_hgvs_p"]
            by_name = [ids.hgvs_gn_id(F.col("sequence"), F.col("gene_name"), F.col(c)).alias(f"id_hgvs_gn_{c[-1]}") for c in ("hgvs_c", "hgvs_p")]
            out = out.join(self.db.annotations.select(F.col("spdi").alias("feature"), *notes, *by_name), "feature", "left")
        return out

    def features_comparison(self, categories: dict[str, SamplesQuery] | str, kind: str = "mutations", unit: str = "percent", category_samples_threshold: int | None = None, include_unknown_samples: bool = False, only_samples_in_categories: bool = True) -> DataFrame:
        """By queries under names, or by the values of a metadata column, MOST_CATEGORIES of them at most."""
        if isinstance(categories, str):
            rows = self.metadata.where(F.col(_quoted(categories)).isNotNull()).select("sample_id", F.col(_quoted(categories)).cast("string").alias("category"))
            names = [r[0] for r in rows.select("category").distinct().orderBy("category").limit(MOST_CATEGORIES + 1).collect()]
            if len(names) > MOST_CATEGORIES:
                raise ValueError(f"{categories} has more than {MOST_CATEGORIES} values, each of which would be several columns")
        else:
            names, rows = list(categories), None
            for n, q in categories.items():
                part = q._selected().withColumn("category", F.lit(n))
                rows = part if rows is None else rows.union(part)
        table, columns = self._table(kind, True, False)
        unknown = self._unknowns(kind, table) if include_unknown_samples else None
        return features.comparison(table, columns, rows, names, unit, self._selected(), unknown, category_samples_threshold, only_samples_in_categories)

    def variants(self, which: Column | None = None) -> DataFrame:
        """The calls of the present samples that a predicate over the call table's columns holds of."""
        calls = self.db.calls if which is None else self.db.calls.where(which)
        return calls.join(self._selected(), "sample_id", "left_semi")

    def tofeaturesset(self, kind: str = "mutations") -> set[str]:
        table, _ = self._table(kind, True, False)
        return {r[0] for r in table.join(self._selected(), "sample_id", "left_semi").select("feature").distinct().collect()}

    def _sketch(self, kmer_size: int) -> DataFrame:
        return self.db.sketch.where(F.col("ksize") == kmer_size)

    def to_distances(self, kind: str = "kmer", kmer_size: int = 31):
        """(sample ids, matrix) of the present samples on the driver, for as many as fit there; distance_pairs() has
        no such bound. A sample without sketch is an error."""
        if kind != "kmer":
            raise ValueError(f"unknown kind {kind}")
        return kmer.distance_matrix(self._sketch(kmer_size), self._selected())

    def feature_sites(self, listed: list[str]) -> typing.Sites:
        """Statuses at many features: variants in one scan of the calls, others in one each."""
        parsed = [ids.parse_feature(f) for f in listed]
        if parsed and all(isinstance(f, ids.Spdi) for f in parsed):
            return typing.Sites(len(parsed), lookup.sites_status(self.db.calls, parsed))
        return typing.sites_of([self.feature_status(f) for f in parsed])

    def typed(self, definition: typing.Definition, strict: bool = True, perfect_only: bool = False) -> SamplesQuery:
        """Samples that match a typing definition."""
        must = self.feature_sites(list(definition.must_have)) if definition.must_have else None
        new = typing.isa_type(self.state, self.feature_sites(list(definition.sites)), must, definition.needed, definition.max_ref, strict, perfect_only)
        return self._next(new, f"isa_type('{definition.label}')")

    def score_groups(self, column: str, **how) -> DataFrame:
        meta = self.metadata.select("sample_id", F.col(_quoted(column)).alias("value")).join(self.db.samples, "sample_id").select(F.col("sample_name").alias("name"), "value")
        return cluster.score_groupby(self._tree(), meta, "value", **how)

    def tree_annotations(self, columns: dict[str, SamplesQuery], colors: tuple[str, str, str] = ("white", "lightgray", "black"), leaf_name: Callable[[Column], Column] | None = None) -> DataFrame:
        """(leaf, column, status, color) of each leaf for each named query: what a tree picture shows.
        The states meet by sample in one aggregation; leaf_name renames the leaves, from their name and,
        if metadata is joined, its columns."""
        leaves = self._tree().where("is_leaf").join(self.db.samples.withColumnRenamed("sample_name", "name"), "name")
        if self.metadata is not None:
            meta, _ = self._metadata_beside(leaves.columns)
            leaves = leaves.join(meta, leaves["sample_id"] == meta["_key"], "left")
        leaves = leaves.select((leaf_name(F.col("name")) if leaf_name else F.col("name")).alias("leaf"), "sample_id")
        marks = None
        for i, q in enumerate(columns.values()):
            part = q.state.select("sample_id", F.lit(i).alias("i"), "status")
            marks = part if marks is None else marks.union(part)
        if marks is None:
            raise ValueError("no queries to show")
        wide = marks.groupBy("sample_id").agg(*[F.max(F.when(F.col("i") == i, F.col("status"))).alias(f"_{i}") for i in range(len(columns))])
        cells = F.array(*[F.struct(F.lit(n).alias("column"), F.coalesce(F.col(f"_{i}"), F.lit(ABSENT)).alias("s")) for i, n in enumerate(columns)])
        rows = leaves.join(wide, "sample_id", "left").select("leaf", F.explode(cells).alias("c"))
        shade = F.element_at(F.array(*[F.lit(c) for c in colors]), F.col("c.s") + 1)
        return rows.select("leaf", "c.column", ids.status_label(F.col("c.s")).alias("status"), shade.alias("color"))


@dataclass(frozen=True)
class ExperimentalTreeQuery(SamplesQuery):
    """A tree query whose tree is pruned to the present samples after each step, from a tree of the
    whole universe that is kept beside it; reset_universe() makes the pruned tree the universe's.
    Trees are pruned when they are asked for."""

    universe_nodes: Any = None

    @property
    def universe_root(self) -> tree.Node:
        return tree.from_nodes(made(self.universe_nodes))

    def _next(self, new: DataFrame, step: str, **more) -> SamplesQuery:
        out = super()._next(new, step, **more)
        if "nodes" in more:  # a tree was joined: it is the universe's from now on
            root = more.get("root")
            return replace(out, universe_nodes=more["nodes"] if root is None else tree.tree_nodes(new.sparkSession, root))
        return out._pruned()

    def _pruned(self) -> SamplesQuery:
        def whole() -> DataFrame:
            names = self.db.samples.join(self._selected(), "sample_id", "left_semi").select(F.col("sample_name").alias("name"))
            if self.reference_leaf:
                names = names.union(names.sparkSession.createDataFrame([(self.reference_leaf,)], "name string"))
            return paths.pruned(made(self.universe_nodes), names)

        table = Later(whole)
        shown = table
        if self.reference_leaf:
            shown = Later(lambda: table.where(~(F.col("is_leaf") & (F.col("name") == self.reference_leaf))))
        return replace(self, root=Later(lambda: tree.from_nodes(table.made())), nodes=shown)

    def reset_universe(self, include_unknown: bool = True) -> SamplesQuery:
        out = super().reset_universe(include_unknown)
        kept = out.root
        return replace(out, universe_nodes=Later(lambda: tree.tree_nodes(out.state.sparkSession, made(kept))))


def register_typer(query: SamplesQuery, kind: str, typer: Callable[[Any, SamplesQuery], SamplesQuery]) -> SamplesQuery:
    return replace(query, typers={**query.typers, kind: typer})

