"""Feature identifiers: Column functions over whole tables, and driver-side parsing of a single id.

SPDI ``seq:pos:del:ins`` (1-based; del a length or bases), HGVS ``hgvs:seq[:gene]:variant``, HGVS by
gene name ``hgvs_gn:seq:gene:variant`` and MLST ``mlst:scheme:locus[:allele]``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from triloom.schema import STATUS_LABELS, UNKNOWN_ALLELE, UNKNOWN_INSERTION, UNKNOWN_TYPE

_DIGITS, _BASES = "^[0-9]+$", "^[ATCGN]*$"


class FeatureError(ValueError):
    """An id that no grammar accepts."""


@dataclass(frozen=True)
class Spdi:
    sequence: str
    position: int
    deletion: int
    insertion: str

    @property
    def id(self) -> str:
        return f"{self.sequence}:{self.position}:{self.deletion}:{self.insertion}"

    @property
    def stop(self) -> int:
        return self.position + self.deletion


@dataclass(frozen=True)
class Hgvs:
    sequence: str
    gene: str | None
    variant: str

    @property
    def nucleotide(self) -> bool:
        return self.variant[:2] in ("c.", "n.")

    @property
    def id(self) -> str:
        return ":".join(["hgvs", self.sequence, *([self.gene] if self.gene else []), self.variant])


@dataclass(frozen=True)
class HgvsGn:
    sequence: str
    gene: str
    variant: str

    @property
    def nucleotide(self) -> bool:
        return self.variant[:2] in ("c.", "n.")

    @property
    def id(self) -> str:
        return f"hgvs_gn:{self.sequence}:{self.gene}:{self.variant}"


@dataclass(frozen=True)
class Mlst:
    scheme: str
    locus: str
    allele: str = "*"

    @property
    def id(self) -> str:
        return f"mlst:{self.scheme}:{self.locus}:{self.allele}"


def _variant(text: str, whole: str) -> str:
    if text[:2] not in ("c.", "n.", "p."):
        raise FeatureError(f"[{whole}] is neither a nucleotide nor a protein variant")
    return text


def parse_feature(text: str) -> Spdi | Hgvs | HgvsGn | Mlst:
    """The feature an id names; the prefix decides, SPDI is the default."""
    parts = text.split(":")
    if parts[0] == "hgvs":
        if len(parts) not in (3, 4):
            raise FeatureError(f"Unknown feature type [{text}]")
        return Hgvs(parts[1], parts[2] if len(parts) == 4 else None, _variant(parts[-1], text))
    if parts[0] == "hgvs_gn":
        if len(parts) != 4:
            raise FeatureError(f"Unknown feature type [{text}]")
        return HgvsGn(parts[1], parts[2], _variant(parts[3], text))
    if parts[0] == "mlst":
        if len(parts) not in (3, 4):
            raise FeatureError(f"Unknown feature type [{text}]")
        out = Mlst(*parts[1:])
        if out.scheme == "*" or (out.locus == "*" and out.allele != "*"):
            raise FeatureError(f"[{text}]: the scheme may not be *, nor a locus with an allele")
        return out
    if len(parts) != 4 or "*" in parts[:3]:
        raise FeatureError(f"Unknown feature type [{text}]")
    sequence, position, deletion, insertion = parts
    if not re.match(_DIGITS, position):
        raise FeatureError(f"[{text}]: the position is not a number from 0")
    if re.match(_DIGITS, deletion):
        length = int(deletion)
    elif re.match(_BASES, deletion):
        length = len(deletion)
    else:
        raise FeatureError(f"[{text}]: the deletion is neither a length nor bases")
    if insertion != UNKNOWN_INSERTION and not re.match(_BASES, insertion):
        raise FeatureError(f"[{text}]: the insertion is not made of bases")
    return Spdi(sequence, int(position), length, insertion)


def same_class(features: list[str]) -> type:
    """The class all features share; an error if there are several."""
    kinds = {type(parse_feature(f)) for f in features}
    if len(kinds) != 1:
        raise FeatureError(f"features of {len(kinds)} kinds in one call: {sorted(k.__name__ for k in kinds)}")
    return kinds.pop()


# Column functions.


def feature_kind(c: Column) -> Column:
    return F.when(c.startswith("hgvs_gn:"), "hgvs_gn").when(c.startswith("hgvs:"), "hgvs").when(c.startswith("mlst:"), "mlst").otherwise("spdi")


def spdi_part(c: Column, n: int) -> Column:
    return F.split(c, ":")[n]


def spdi_parse(c: Column) -> Column:
    """struct(sequence, position, deletion, insertion); an id without exactly four parts is an error."""
    parts = F.when(F.size(F.split(c, ":")) == 4, F.split(c, ":")).otherwise(F.raise_error(F.concat(F.lit("not an SPDI: "), c)))
    return F.struct(parts[0].alias("sequence"), parts[1].cast("int").alias("position"), parts[2].alias("deletion"), parts[3].alias("insertion"))


def spdi_format(sequence: Column, position: Column, deletion: Column, insertion: Column) -> Column:
    return F.concat_ws(":", sequence, position.cast("string"), deletion.cast("string"), insertion)


def deletion_length(deletion: Column) -> Column:
    return F.coalesce(deletion.try_cast("int"), F.length(deletion))


def spdi_normalize(c: Column) -> Column:
    """The deletion as a length; ids outside the alphabet are an error."""
    parts = F.split(c, ":")
    good = parts[2].rlike(r"^([0-9]+|[ATCGN]*)$") & parts[3].rlike(r"^(\?|[ATCGN]*)$") & parts[1].rlike(_DIGITS)
    out = F.concat_ws(":", parts[0], parts[1], deletion_length(parts[2]).cast("string"), parts[3])
    return F.when(good, out).otherwise(F.raise_error(F.concat(F.lit("not an SPDI: "), c)))


def to_unknown(c: Column) -> Column:
    parts = F.split(c, ":")
    return F.concat_ws(":", parts[0], parts[1], parts[2], F.lit(UNKNOWN_INSERTION))


def unknown_positions(position: Column, deletion: Column) -> Column:
    """The deleted positions one by one; none where nothing is deleted."""
    return F.when(deletion > 0, F.sequence(position, position + deletion - 1)).otherwise(F.array().cast("array<int>"))


def is_unknown(var_type: Column) -> Column:
    return var_type == UNKNOWN_TYPE


def is_unknown_allele(allele: Column) -> Column:
    return allele == UNKNOWN_ALLELE


def hgvs_id(sequence: Column, gene_id: Column, variant: Column) -> Column:
    """Null without variant; an n. variant and a missing gene leave the gene out."""
    gene = F.when(variant.startswith("n."), F.lit(None)).otherwise(gene_id)
    return F.when(variant.isNotNull(), F.concat_ws(":", F.lit("hgvs"), sequence, gene, variant))


def hgvs_gn_id(sequence: Column, gene_name: Column, variant: Column) -> Column:
    gene = F.when(variant.startswith("n."), F.lit(None)).otherwise(gene_name)
    return F.when(variant.isNotNull(), F.concat_ws(":", F.lit("hgvs_gn"), sequence, gene, variant))


def hgvs_kind(variant: Column) -> Column:
    return F.when(variant.startswith("c.") | variant.startswith("n."), "nucleotide").when(variant.startswith("p."), "protein")


def mlst_id(scheme: Column, locus: Column, allele: Column) -> Column:
    return F.concat(F.lit("mlst:"), F.concat_ws(":", scheme, locus, allele))


def validate_allele(allele: Column) -> Column:
    return F.when(allele.rlike(_DIGITS), allele).otherwise(F.lit(UNKNOWN_ALLELE))


def sample_from_filename(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^([^.]*)", 1)


def status_label(status: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in STATUS_LABELS]), status + 1)


def percent(count: Column, total: Column) -> Column:
    return F.try_divide(count.cast("double"), total.cast("double")) * 100.0


def variant_type(ref: Column, alt: Column) -> Column:
    """SNP, MNP or INDEL by the lengths of REF and ALT, OTHER for symbolic alleles."""
    bases = ref.rlike("^[ACGTNacgtn]+$") & alt.rlike("^[ACGTNacgtn]+$")
    same = F.length(ref) == F.length(alt)
    return F.when(~bases, "OTHER").when(same & (F.length(ref) == 1), "SNP").when(same, "MNP").otherwise("INDEL")


_EXTENSION = r"\.(fasta|fa|fna|fastq|fq|gb|gbk|gbff)$"


def genome_name(path: Column, paired: bool = False) -> Column:
    """The file name without compression and sequence extension and, on request, without read-pair mark."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.(gz|xz|bz2)$", "")
    name = F.regexp_replace(name, _EXTENSION, "")
    if paired:
        cut = name
        for mark in reversed(PAIR_MARKS):
            cut = F.when(name.contains(mark), F.regexp_extract(name, rf"^(.*){mark}", 1)).otherwise(cut)
        return cut
    return name


# Marks of paired reads, in the order they are looked for.
PAIR_MARKS = ["_1", "_2", "_R1", "_R2", "_f", "_r"]


def sanitize_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.\-]", "__")


def persistence_name(name: Column) -> Column:
    """A file name for a sample's data, whatever its name."""
    return F.md5(name)


def size_in_unit(bytes_: Column, unit: str = "B") -> Column:
    power = {"B": 0, "KB": 1, "MB": 2, "GB": 3}[unit]
    return bytes_ / F.lit(float(1024**power))


# Constellation sites.

# Aliases and names of the genes that sites refer to.
GENE_ALIASES = {
    "s": "S",
    "1ab": "ORF1ab",
    "orf1ab": "ORF1ab",
    "ORF1a": "ORF1ab",
    "ORF1b": "ORF1ab",
    "NSP2": "ORF1ab",
    "nsp3": "ORF1ab",
    "nsp4": "ORF1ab",
    "nsp5": "ORF1ab",
    "nsp6": "ORF1ab",
    "nsp7": "ORF1ab",
    "nsp12": "ORF1ab",
    "nsp13": "ORF1ab",
    "nsp15": "ORF1ab",
    "8": "ORF8",
}
GENES = ["ORF1ab", "S", "ORF3a", "E", "M", "ORF6", "ORF7a", "ORF7b", "ORF8", "N", "ORF10"]


def aa_deletion_name(c: Column) -> Column:
    """HV69- is H69_V70del, Y144- is Y144del; null for anything else."""
    acids, at = F.regexp_extract(c, r"^(\D+)(\d+)-$", 1), F.regexp_extract(c, r"^(\D+)(\d+)-$", 2)
    n = F.length(acids)
    last = (at.try_cast("int") + n - 1).cast("string")
    several = F.concat(F.substring(acids, 1, 1), at, F.lit("_"), F.substring(acids, n, F.lit(1)), last, F.lit("del"))
    return F.when(n == 1, F.concat(acids, at, F.lit("del"))).when(n > 1, several)


def constellation_id(site: Column, sequence_name: str, bases: Column, genes: list[str] | None = None) -> Column:
    """The SPDI or hgvs_gn id of a site; null for a site that cannot be read. bases: the whole reference."""
    p = F.split(site, ":")
    alias = F.create_map(*[F.lit(x) for kv in GENE_ALIASES.items() for x in kv])
    gene = F.coalesce(alias[p[0]], p[0])
    nuc = r"^([ATCG]+)(\d+)([ATCG]+)"
    spdi = F.concat_ws(":", F.lit(sequence_name), F.regexp_extract(p[1], nuc, 2), F.regexp_extract(p[1], nuc, 1), F.regexp_extract(p[1], nuc, 3))
    change = F.when(p[1].endswith("-"), aa_deletion_name(p[1])).otherwise(p[1])
    protein = F.concat(F.lit(f"hgvs_gn:{sequence_name}:"), gene, F.lit(":p."), change)
    at, n = F.get(p, 1).try_cast("int"), F.get(p, 2).try_cast("int")
    gone = F.concat_ws(":", F.lit(sequence_name), at.cast("string"), F.substring(bases, at, n + 1), F.substring(bases, at, F.lit(1)))
    two, three = F.size(p) == 2, F.size(p) == 3
    return (
        F.when(two & (p[0] == "nuc") & p[1].rlike(nuc), spdi)
        .when(two & (p[0] != "nuc") & gene.isin(genes or GENES), protein)
        .when(three & (p[0] == "del") & (at >= 1) & n.isNotNull(), gone)
    )
