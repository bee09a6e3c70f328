"""Command line: python -m triloom.cli --project DIR VERB ..."""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import functions as F

from triloom import loading
from triloom.index import SampleIndex, init_project, open_project
from triloom.operators import align, tree
from triloom.query import SamplesQuery
from triloom.sources import readers, sinks


def apply(query: SamplesQuery, command: str) -> SamplesQuery:
    """hasa:FEATURE, isa:SAMPLE, isin_N_UNITS:SAMPLE or isin_mrca:SAMPLES; anything else is a feature."""
    if m := re.fullmatch(r"isin_([0-9.]+)_(\w+(?:/\w+)?):(.+)", command):
        return query.isin(m[3].split(","), kind="distance", distance=float(m[1]), units=m[2])
    verb, _, rest = command.partition(":")
    if verb == "hasa":
        return query.hasa(rest)
    if verb == "isa":
        return query.isa(rest)
    if verb == "isin_mrca":
        return query.isin(rest.split(","), kind="mrca")
    return query.hasa(command)


def _align(v: argparse.ArgumentParser) -> None:
    v.add_argument("--align-type", choices=["core", "full"], default="full")
    v.add_argument("--include-variants", action="append", choices=list(align.VARIANTS))


def _how(a) -> dict:
    """Alignment options; a core alignment is of SNPs only."""
    return {"align_type": a.align_type, "include_variants": None if a.align_type == "core" else tuple(a.include_variants or align.VARIANTS)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="triloom")
    p.add_argument("--project", required=True)
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init")
    both = argparse.BooleanOptionalAction
    load = verbs.add_parser("load")
    load.add_argument("kind", choices=["vcf", "snippy", "vcf-kmer", "kmer", "mlst-tseemann", "mlst-sistr", "mlst-chewbbaca"])
    load.add_argument("path")
    load.add_argument("--scheme-name", default="AUTO")
    run = verbs.add_parser("analysis")
    run.add_argument("genomes", nargs="*")
    run.add_argument("--artefacts", required=True, help="folder of variant calls and masks by sample")
    run.add_argument("--input-genomes-file")
    run.add_argument("--input-structured-genomes-file")
    run.add_argument("--load-data", action=both, default=True)
    run.add_argument("--include-kmer", action=both, default=False)
    run.add_argument("--skip-existing-samples", action=both, default=False)
    run.add_argument("--check-files-exist", action=both, default=True)
    for v in (load, run):
        v.add_argument("--reference-file", required=v is run)
        v.add_argument("--reference-name")
        v.add_argument("--index-unknown", action=both, default=True)
        v.add_argument("--sample-batch-size", type=int, default=loading.BATCH)
        v.add_argument("--kmer-size", type=int, action="append")
        v.add_argument("--kmer-scaled", type=int, default=1000)
        v.add_argument("--build-tree", action=both, default=False)
        _align(v)
    show = verbs.add_parser("list")
    show.add_argument("kind", choices=["genomes", "samples"])
    for name in ("input", "input-split-file"):
        v = verbs.add_parser(name)
        v.add_argument("files", nargs="+")
        v.add_argument("--absolute", action="store_true")
        v.add_argument("--output")
        v.add_argument("--subsample", type=float)
        v.add_argument("--seed", type=int, default=0)
    export = verbs.add_parser("export")
    export.add_argument("kind", choices=["tree"])
    export.add_argument("name")
    export.add_argument("--ascii", action="store_true")
    for name in ("build", "rebuild"):
        v = verbs.add_parser(name)
        v.add_argument("kind", choices=["alignment", "tree"])
        v.add_argument("--reference-name", required=True)
        _align(v)
        v.add_argument("--output")
    q = verbs.add_parser("query")
    q.add_argument("commands", nargs="*")
    q.add_argument("--reference-name")
    q.add_argument("--summary", action="store_true")
    q.add_argument("--features-summary", choices=["mutations", "mlst"])
    q.add_argument("--features-summary-unique", choices=["mutations", "mlst"])
    q.add_argument("--output")
    db = verbs.add_parser("db")
    db.add_argument("what", choices=["size", "sets", "compact"])
    db.add_argument("--unit", choices=["B", "KB", "MB", "GB"], default="B")
    return p


def _show(rows, output: str | None) -> None:
    if output:
        sinks.query_tsv(rows, output)
    else:
        cells = lambda r: ["-" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x) for x in r]
        print("\t".join(rows.columns))
        for r in rows.toLocalIterator():
            print("\t".join(cells(r)))


def _reference(a, spark, index: SampleIndex) -> str | None:
    """The name of the reference that is loaded with, added if it is new."""
    name = a.reference_name
    if a.reference_file:
        name = name or re.sub(r"\..*$", "", a.reference_file.rsplit("/", 1)[-1])
        if index.references.where(F.col("reference_name") == name).isEmpty():
            index.add_reference(name, readers.sequences(spark, a.reference_file).select("sequence", "bases"))
    return name


def _load(a, spark, index: SampleIndex) -> None:
    name, sizes = _reference(a, spark, index), a.kmer_size or [31]
    if a.kind in ("vcf", "vcf-kmer"):
        rows = [r.asDict() for r in readers.vcf_fofn(spark, a.path).collect()]  # names of files, one row a sample
        loading.load_vcfs(index, [(r["Sample"], r["VCF"], r.get("Mask File")) for r in rows], a.sample_batch_size, a.index_unknown)
        if a.kind == "vcf-kmer":
            loading.load_signatures(index, [(r["Sample"], r["Sketch File"]) for r in rows if r.get("Sketch File")], sizes, a.sample_batch_size)
    elif a.kind == "snippy":
        index.add_variants(*readers.snippy_dirs(spark, a.path), index_unknown=a.index_unknown)
    elif a.kind == "kmer":
        known = index.samples.join(index.with_kmer_index(), "sample_id", "left_semi")
        sheet = [(r["Sample"], r["File"]) for r in readers.kmer_fofn(spark, a.path, known).orderBy("Sample", "File").collect()]
        loading.load_kmers(index, sheet, sizes, a.kmer_scaled, a.sample_batch_size)
    else:
        scheme = None if a.scheme_name == "AUTO" else a.scheme_name
        if a.kind == "mlst-tseemann":
            rows = readers.mlst_tseemann(spark.read.text(a.path), scheme)
        elif a.kind == "mlst-sistr":
            rows = readers.mlst_sistr(spark, a.path, scheme or "sistr_330")
        else:
            rows = readers.mlst_chewbbaca(spark, a.path, scheme or "default")
        index.add_mlst(rows)
    if a.build_tree and name:
        index.rebuild_tree(name, **_how(a))


def _analysis(a, spark, index: SampleIndex) -> int:
    if a.input_structured_genomes_file:
        sheet = [tuple(r) for r in readers.sample_sheet(spark, a.input_structured_genomes_file).collect()]
    else:
        files = [r[0] for r in readers.genome_list(spark, a.input_genomes_file).collect()] if a.input_genomes_file else a.genomes
        sheet = readers.pair_reads(files)
    name = _reference(a, spark, index)
    sizes = (a.kmer_size or [31]) if a.include_kmer else None
    found, skipped = loading.analyse(index, sheet, a.artefacts, a.skip_existing_samples, a.check_files_exist, a.load_data, a.index_unknown, sizes, a.kmer_scaled, a.sample_batch_size)
    if skipped:
        print(f"skipped {len(skipped)} of {len(sheet)} samples: {', '.join(skipped[:10])}", file=sys.stderr)
    if not a.load_data:
        print("Sample\tVCF\tMask File")
        for r in found:
            print("\t".join(x or "NA" for x in r))
    elif found and a.build_tree:
        index.rebuild_tree(name, **_how(a))
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if a.verb == "init":
        init_project(spark, a.project)
        return 0
    if a.verb == "input":
        print(sinks.samples_tsv(readers.pair_reads(a.files), a.output, a.absolute, spark), end="")
        return 0
    index = open_project(spark, a.project)
    if a.verb == "load":
        _load(a, spark, index)
    elif a.verb == "analysis":
        return _analysis(a, spark, index)
    elif a.verb == "list":
        rows = index.samples.select("sample_name") if a.kind == "samples" else index.references.select("reference_name").distinct()
        for r in rows.orderBy(rows.columns[0]).toLocalIterator():
            print(r[0])
    elif a.verb == "input-split-file":
        seqs = readers.sequences(spark, a.files)
        sinks.split_fasta(readers.random_sequences(seqs, a.subsample, a.seed) if a.subsample else seqs, a.output)
    elif a.verb == "export":
        stored = index.stored_tree(a.name)
        if not stored:
            print(f"no tree for {a.name}", file=sys.stderr)
            return 1
        print(sinks.ascii_tree(tree.parse_newick(stored[0])) if a.ascii else stored[0])
    elif a.verb == "build" and a.kind == "alignment":
        rows = SamplesQuery.on_reference(index, a.reference_name).alignment(a.reference_name, **_how(a))
        sinks.alignment_fasta(rows, a.output) if a.output else [print(f">{r[0]}\n{r[1]}") for r in rows.orderBy("record_id").toLocalIterator()]
    elif a.verb in ("build", "rebuild"):
        if a.verb == "rebuild":
            print(index.rebuild_tree(a.reference_name, **_how(a)))
        else:
            newick = tree.to_newick(SamplesQuery.on_reference(index, a.reference_name).build_tree("mutation", reference_name=a.reference_name, **_how(a)).root)
            sinks.newick_file(spark, newick, a.output) if a.output else print(newick)
    elif a.verb == "query":
        q = SamplesQuery.on_reference(index, a.reference_name) if a.reference_name else SamplesQuery.all(index)
        for c in a.commands:
            q = apply(q, c)
        if a.summary:
            rows = q.summary()
        elif a.features_summary or a.features_summary_unique:
            kind = a.features_summary or a.features_summary_unique
            rows = q.features_summary(kind, "all" if a.features_summary else "unique").orderBy(F.desc("count"), "feature")
        else:
            rows = q.toframe(include_unknown=True, include_absent=True)
        _show(rows, a.output)
    elif a.verb == "db":
        if a.what == "sets":
            index.build_sets()
        elif a.what == "compact":
            for name in ("calls", "annotations", "mlst", "masks", "kmer", "sample_sets"):
                index.compact(name)
        _show(index.sizes(a.unit), None)
    return 0


if __name__ == "__main__":
    sys.exit(main())
