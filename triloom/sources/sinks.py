"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triloom.session import ship, write_text


def mask_bed(masks: DataFrame, path: str) -> None:
    """Gzipped BED part files, sorted within each."""
    t = masks.select("sequence", "start0", "end0").repartitionByRange("sequence", "start0").sortWithinPartitions("sequence", "start0")
    t.write.mode("overwrite").csv(path, sep="\t", compression="gzip")


def alignment_fasta(alignment: DataFrame, path: str) -> None:
    """FASTA part files in order of the record ids."""
    t = alignment.repartitionByRange("record_id").sortWithinPartitions("record_id")
    t.select(F.concat(F.lit(">"), "record_id", F.lit("\n"), "alignment")).write.mode("overwrite").text(path)


def query_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated with header, doubles to four significant digits, null as -."""
    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        text = F.format_string("%.4g", c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.cast("string")
        return F.when(c.isNull(), "-").otherwise(text).alias(f.name)

    rows.select([cell(f) for f in rows.schema]).write.mode("overwrite").csv(path, sep="\t", header=True)


def samples_tsv(rows: list[tuple], path: str | None = None, absolute: bool = False, spark=None) -> str:
    """The sample sheet as text, and to a file if a path is given."""
    from pathlib import Path

    full = lambda x: "" if x is None else str(Path(x).absolute()) if absolute else x
    text = "\t".join(["Sample", "Assemblies", "Reads1", "Reads2"]) + "\n" + "".join("\t".join([r[0], *map(full, r[1:])]) + "\n" for r in rows)
    if path:
        write_text(spark, path, text)
    return text


def samples_table(rows: DataFrame, path: str) -> None:
    """A sheet of samples of any number: rows (sample, assembly, reads1, reads2) as files with a header each."""
    named = rows.select(*[F.col(c).alias(n) for c, n in zip(("sample", "assembly", "reads1", "reads2"), ("Sample", "Assemblies", "Reads1", "Reads2"), strict=True)])
    named.write.csv(path, sep="\t", header=True)


def split_fasta(seqs: DataFrame, path: str) -> None:
    """One gzipped FASTA folder a record, named by the sanitised record name; written by the executors."""
    from triloom.functions.ids import sanitize_name

    t = seqs.select(sanitize_name(F.col("sequence")).alias("record"), F.concat(F.lit(">"), "sequence", F.lit("\n"), "bases").alias("value"))
    t.write.mode("overwrite").partitionBy("record").option("compression", "gzip").text(path)


def newick_file(spark, newick: str, path: str) -> None:
    write_text(spark, path, newick + "\n")


def ascii_tree(root) -> str:
    """A plain picture of a tree, one node a line."""
    out, todo = [], [(root, 0)]
    while todo:
        n, depth = todo.pop()
        out.append("  " * depth + (n.name or "+"))
        todo += [(c, depth + 1) for c in reversed(n.children)]
    return "\n".join(out)


#: Signature documents of a file: a reader holds a file at a time.
_DOCUMENTS = 1000


def signatures(sketch: DataFrame, path: str, scaled: int = 1000) -> None:
    """A signature document a sample, one a line, from (sample, ksize, hash); readers.signatures() reads
    them again. A group is a sample's sketch, of its genome's size / scaled."""
    ship(sketch.sparkSession)

    def document(own):
        import json

        import pandas as pd

        from triloom.sources import formats

        by = {int(k): g["hash"].tolist() for k, g in own.groupby("ksize")}
        return pd.DataFrame({"sample": [own["sample"].iloc[0]], "value": [json.dumps(formats.signature(own["sample"].iloc[0], by, scaled))]})

    docs = sketch.select("sample", "ksize", "hash").groupBy("sample").applyInPandas(document, "sample string, value string")
    docs.select("value").write.mode("overwrite").option("maxRecordsPerFile", _DOCUMENTS).text(path)


def svg_tree(root, annotations: list[tuple[str, str, str, str]] = (), width: int = 600, row: int = 14) -> str:
    """A drawn tree: branches to scale, leaf names, and for each leaf a square of its color in each
    column of annotations (leaf, column, status, color), as a query's tree_annotations() gives them."""
    from xml.sax.saxutils import escape, quoteattr

    depth, place, order, todo, at = {id(root): 0.0}, {}, [], [root], 0
    while todo:
        n = todo.pop()
        order.append(n)
        if not n.children:
            place[id(n)] = at * row + row
            at += 1
        for c in reversed(n.children):
            depth[id(c)] = depth[id(n)] + max(0.0, c.length)
            todo.append(c)
    for n in reversed(order):
        if n.children:
            place[id(n)] = sum(place[id(c)] for c in n.children) / len(n.children)
    scale = width / (max(depth.values()) or 1.0)
    columns = list(dict.fromkeys(c for _, c, _, _ in annotations))
    shade = {(leaf, c): color for leaf, c, _, color in annotations}
    lines, labels = [], []
    for n in order:
        x, y = depth[id(n)] * scale, place[id(n)]
        for c in n.children:
            lines.append(f"M{x:.1f},{y:.1f}V{place[id(c)]:.1f}H{depth[id(c)] * scale:.1f}")
        if not n.children:
            labels.append(f'<text x="{x + 4:.1f}" y="{y + 4:.1f}" font-size="{row - 3}">{escape(n.name or "")}</text>')
            for k, c in enumerate(columns):
                if (n.name, c) in shade:
                    labels.append(f'<rect x="{width + 160 + k * row}" y="{y - row / 2:.1f}" width="{row - 2}" height="{row - 2}" fill={quoteattr(shade[(n.name, c)])} stroke="gray"/>')
    size = f'width="{width + 160 + row * max(1, len(columns))}" height="{(at + 1) * row}"'
    return f'<svg xmlns="http://www.w3.org/2000/svg" {size}><path d="{"".join(lines)}" fill="none" stroke="black"/>{"".join(labels)}</svg>'
