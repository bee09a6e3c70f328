"""Table schemas, status codes and identifier constants."""

from __future__ import annotations

from pyspark.sql import types as T

ABSENT, UNKNOWN, PRESENT = 0, 1, 2
STATUS_LABELS = ["Absent", "Unknown", "Present"]
UNKNOWN_TYPE = "UNKNOWN_MISSING"
UNKNOWN_INSERTION = UNKNOWN_ALLELE = "?"


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string;string>": T.MapType(T.StringType(), T.StringType()),
    "binary": T.BinaryType(),
}


def struct(columns: str) -> T.StructType:
    """A schema from "name type, ..."; unlike fromDDL it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(","))])


STATE = struct("sample_id long, status int")
SAMPLES = struct("sample_id long, sample_name string")
VARIANT_CALLS = struct("sample_id long, sequence string, position int, deletion int, insertion string, var_type string, spdi string")
#: Positions of a folder of calls: they lie by sequence and position // BIN.
BIN = 1 << 16
MLST_CALLS = struct("sample_id long, scheme string, locus string, allele string")
MASKS = struct("sample_id long, sequence string, start0 long, end0 long")
REFERENCE_SEQUENCES = struct("reference_name string, sequence_name string, length int, sequence string")
KMER_SKETCH = struct("sample_id long, ksize int, hash long")
TREE_NODES = struct(
    "tree_id string, node_id int, parent_id int, name string, branch_length double, depth int, root_dist double, lft int, rgt int, is_leaf boolean"
)
VCF_VARIANTS = struct(
    "sample string, chrom string, pos int, ref string, alt string, type string, file string, variant_id string, info map<string;string>, ann array<string>"
)

# Impact order, and the annotation terms a best annotation is chosen by, strongest first.
IMPACTS = ["HIGH", "MODERATE", "LOW", "MODIFIER"]
ANNOTATION_TERMS = [
    "chromosome_number_variation",
    "exon_loss_variant",
    "frameshift_variant",
    "stop_gained",
    "stop_lost",
    "start_lost",
    "splice_acceptor_variant",
    "splice_donor_variant",
    "rare_amino_acid_variant",
    "missense_variant",
    "disruptive_inframe_insertion",
    "conservative_inframe_insertion",
    "disruptive_inframe_deletion",
    "conservative_inframe_deletion",
    "5_prime_UTR_truncation+exon_loss_variant",
    "3_prime_UTR_truncation+exon_loss",
    "splice_branch_variant",
    "splice_region_variant",
    "stop_retained_variant",
    "initiator_codon_variant",
    "synonymous_variant",
    "initiator_codon_variant+non_canonical_start_codon",
    "coding_sequence_variant",
    "5_prime_UTR_variant",
    "3_prime_UTR_variant",
    "5_prime_UTR_premature_start_codon_gain_variant",
    "intragenic_variant",
    "intergenic_region",
    "upstream_gene_variant",
    "downstream_gene_variant",
    "TF_binding_site_variant",
    "regulatory_region_variant",
    "miRNA",
    "custom",
    "sequence_feature",
    "conserved_intron_variant",
    "intron_variant",
    "conserved_intergenic_variant",
    "non_coding_exon_variant",
    "nc_transcript_variant",
    "gene_variant",
    "chromosome",
]
