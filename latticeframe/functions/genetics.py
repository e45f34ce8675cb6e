"""Calls, loci, alleles and genotype likelihoods as Columns.

A call is struct<alleles array<int>, phased boolean>, a locus struct<contig, position>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticeframe.semantics import col, number_range


def call(*alleles, phased: bool = False) -> Column:
    values = F.array(*[col(a).cast("int") for a in alleles]) if alleles else F.array().cast("array<int>")
    return F.struct((values if phased else F.array_sort(values)).alias("alleles"), F.lit(phased).alias("phased"))


def parse_call(text) -> Column:
    """From text such as 0/1, 0|1 or 1; missing for . alleles and empty text."""
    t = col(text)
    alleles = F.transform(F.split(t, r"[/|]"), lambda a: a.try_cast("int"))
    phased = F.contains(t, F.lit("|"))
    good = F.rlike(t, F.lit(r"^\d+([/|]\d+)*$"))
    return F.when(good, F.struct(F.when(phased, alleles).otherwise(F.array_sort(alleles)).alias("alleles"), phased.alias("phased")))


def call_text(c) -> Column:
    c = col(c)
    digits = F.transform(c["alleles"], lambda a: a.cast("string"))
    return F.when(c["phased"], F.array_join(digits, "|")).otherwise(F.array_join(digits, "/"))


def ploidy(c) -> Column:
    return F.size(col(c)["alleles"])


def allele(c, i: int) -> Column:
    return F.get(col(c)["alleles"], F.lit(i))


def n_alt_alleles(c) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.size(F.filter(c["alleles"], lambda a: a > 0)))


def is_hom_ref(c) -> Column:
    return (ploidy(c) > 0) & (n_alt_alleles(c) == 0)


def is_non_ref(c) -> Column:
    return n_alt_alleles(c) > 0


def is_het(c) -> Column:
    return (ploidy(c) == 2) & (allele(c, 0) != allele(c, 1))


def is_hom_var(c) -> Column:
    return (ploidy(c) == 2) & (allele(c, 0) == allele(c, 1)) & (allele(c, 0) > 0)


def is_het_ref(c) -> Column:
    return is_het(c) & (n_alt_alleles(c) == 1)


def is_het_non_ref(c) -> Column:
    return is_het(c) & (n_alt_alleles(c) == 2)


def is_haploid(c) -> Column:
    return ploidy(c) == 1


def is_diploid(c) -> Column:
    return ploidy(c) == 2


def contains_allele(c, a: int) -> Column:
    return F.array_contains(col(c)["alleles"], a)


def unphase(c) -> Column:
    return F.struct(F.array_sort(col(c)["alleles"]).alias("alleles"), F.lit(False).alias("phased"))


def equals(value):
    return lambda x: x == value


def one_hot_alleles(c, n: int) -> Column:
    alleles = col(c)["alleles"]
    return F.when(alleles.isNotNull(), F.array(*[F.size(F.filter(alleles, equals(i))) for i in range(n)]))


def unphased_diploid_gt_index(c) -> Column:
    """Place of a diploid genotype in the order 0/0, 0/1, 1/1, 0/2, ..."""
    low, high = F.array_min(col(c)["alleles"]), F.array_max(col(c)["alleles"])
    return (high * (high + 1) / 2).cast("int") + low


def unphased_diploid_gt_index_call(i) -> Column:
    i = col(i)
    high = F.floor((F.sqrt(8 * i.cast("double") + 1) - 1) / 2).cast("int")
    low = i - (high * (high + 1) / 2).cast("int")
    return F.struct(F.array(low.cast("int"), high).alias("alleles"), F.lit(False).alias("phased"))


def downcode(c, i: int) -> Column:
    """Alleles equal to i become 1, others 0."""
    c = col(c)
    alleles = F.transform(c["alleles"], lambda a: F.when(a == i, 1).otherwise(0))
    return F.when(c.isNotNull(), F.struct(F.when(c["phased"], alleles).otherwise(F.array_sort(alleles)).alias("alleles"), c["phased"].alias("phased")))


def downcoded_count(i, a_index) -> Column:
    """How many alleles of the diploid genotype with index i are the allele a_index."""
    alleles = unphased_diploid_gt_index_call(i)["alleles"]
    return F.size(F.filter(alleles, lambda a: a == a_index))


# likelihoods


def pl_to_gp(pl) -> Column:
    pl = col(pl)
    weights = F.transform(pl, lambda p: F.pow(F.lit(10.0), -p.cast("double") / 10))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: w / total)


def gp_dosage(gp) -> Column:
    return F.get(col(gp), F.lit(1)) + 2 * F.get(col(gp), F.lit(2))


def pl_dosage(pl) -> Column:
    return gp_dosage(pl_to_gp(pl))


def gq_from_pl(pl) -> Column:
    """The second smallest likelihood less the smallest, at most 99."""
    s = F.array_sort(col(pl))
    return F.least(F.get(s, F.lit(1)) - F.get(s, F.lit(0)), F.lit(99))


# alleles

BASES = "^[ACGTM]+$"  # fixed value: letters of a sequence
PURINES, PYRIMIDINES = ("A", "G"), ("C", "T")  # fixed values


def numeric_kind(ref, alt) -> Column:
    """The allele type's name: SNP, MNP, Insertion, Deletion, Complex, Star, Symbolic or Unknown."""
    r, a = col(ref), col(alt)
    symbolic = F.rlike(a, F.lit(r"^<.*>$")) | F.rlike(a, F.lit(r"^\..+|.+\.$")) | F.rlike(a, F.lit(r"[\[\]]"))
    same = F.length(r) == F.length(a)
    letters = F.rlike(r, F.lit(BASES)) & F.rlike(a, F.lit(BASES))
    differ = F.size(F.filter(F.zip_with(F.split(r, ""), F.split(a, ""), lambda x, y: x.eqNullSafe(y)), lambda e: ~e))
    inserted = (F.length(a) > F.length(r)) & (F.substr(a, F.lit(1), F.lit(1)) == F.substr(r, F.lit(1), F.lit(1))) & a.endswith(F.substr(r, F.lit(2), F.length(r)))
    deleted = (F.length(a) < F.length(r)) & (F.substr(a, F.lit(1), F.lit(1)) == F.substr(r, F.lit(1), F.lit(1))) & r.endswith(F.substr(a, F.lit(2), F.length(a)))
    return (
        F.when(r.isNull() | a.isNull(), None)
        .when(a == "*", "Star")
        .when(symbolic, "Symbolic")
        .when(~letters | (r == a), "Unknown")
        .when(same & (differ == 1), "SNP")
        .when(same, "MNP")
        .when(inserted, "Insertion")
        .when(deleted, "Deletion")
        .otherwise("Complex")
    )


allele_type = numeric_kind


def is_snp(ref, alt) -> Column:
    return allele_type(ref, alt) == "SNP"


def is_mnp(ref, alt) -> Column:
    return allele_type(ref, alt) == "MNP"


def is_insertion(ref, alt) -> Column:
    return allele_type(ref, alt) == "Insertion"


def is_deletion(ref, alt) -> Column:
    return allele_type(ref, alt) == "Deletion"


def is_indel(ref, alt) -> Column:
    return allele_type(ref, alt).isin("Insertion", "Deletion")


def is_star(ref, alt) -> Column:
    return allele_type(ref, alt) == "Star"


def is_complex(ref, alt) -> Column:
    return allele_type(ref, alt) == "Complex"


def changed_base(ref, alt) -> Column:
    """struct<r, a> of the one place where two alleles of a SNP differ."""
    pairs = F.zip_with(F.split(col(ref), ""), F.split(col(alt), ""), lambda x, y: F.struct(x.alias("r"), y.alias("a")))
    return F.get(F.filter(pairs, lambda p: p["r"] != p["a"]), F.lit(0))


def is_transition(ref, alt) -> Column:
    c = changed_base(ref, alt)
    return is_snp(ref, alt) & ((c["r"].isin(*PURINES) & c["a"].isin(*PURINES)) | (c["r"].isin(*PYRIMIDINES) & c["a"].isin(*PYRIMIDINES)))


def is_transversion(ref, alt) -> Column:
    return is_snp(ref, alt) & ~is_transition(ref, alt)


def is_strand_ambiguous(ref, alt) -> Column:
    return F.concat(col(ref), col(alt)).isin("AT", "TA", "CG", "GC")


def reverse_complement(s) -> Column:
    return F.reverse(F.translate(col(s), "ACGTacgt", "TGCAtgca"))


def min_rep(position, ref, alt) -> Column:
    """struct<position, ref, alt> with the shared suffix, then the shared prefix taken off, at least a base of each left."""
    r, a = col(ref), col(alt)
    shared = lambda x, y: F.aggregate(
        F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce(p == q, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")),
    )["n"]
    most = F.least(F.length(r), F.length(a)) - 1
    tail = F.least(shared(F.reverse(r), F.reverse(a)), most)
    r2, a2 = r.substr(F.lit(1), F.length(r) - tail), a.substr(F.lit(1), F.length(a) - tail)
    head = F.least(shared(r2, a2), F.least(F.length(r2), F.length(a2)) - 1)
    return F.struct((col(position) + head).alias("position"), r2.substr(head + 1, F.length(r2)).alias("ref"), a2.substr(head + 1, F.length(a2)).alias("alt"))


# loci


class ReferenceGenome:
    """Contigs in order with their lengths, and the contigs and pseudo-autosomal intervals (contig, start, end) of the sex chromosomes."""

    def __init__(self, name: str, lengths: dict[str, int], x: str | None = None, y: str | None = None, mt: str | None = None, par=()):
        self.name, self.lengths, self.x, self.y, self.mt, self.par = name, dict(lengths), x, y, mt, list(par)
        self.order = {c: i for i, c in enumerate(self.lengths)}

    def table(self, values: dict) -> Column:
        return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])

    def is_valid_contig(self, contig) -> Column:
        return col(contig).isin(list(self.lengths))

    def contig_length(self, contig) -> Column:
        return F.try_element_at(self.table(self.lengths), col(contig))

    def contig_idx(self, contig) -> Column:
        return F.try_element_at(self.table(self.order), col(contig))

    def is_valid_locus(self, contig, position) -> Column:
        return F.coalesce(self.is_valid_contig(contig) & (col(position) >= 1) & (col(position) <= self.contig_length(contig)), F.lit(False))

    def global_position(self, contig, position) -> Column:
        starts, at = {}, 0
        for c, n in self.lengths.items():
            starts[c] = at
            at += n
        return F.try_element_at(self.table(starts), col(contig)).cast("long") + col(position) - 1

    def in_par(self, contig, position) -> Column:
        out = F.lit(False)
        for c, a, b in self.par:
            out = out | ((col(contig) == c) & (col(position) >= a) & (col(position) < b))
        return out

    def in_x_par(self, contig, position) -> Column:
        return (col(contig) == self.x) & self.in_par(contig, position)

    def in_x_nonpar(self, contig, position) -> Column:
        return (col(contig) == self.x) & ~self.in_par(contig, position)

    def in_y_par(self, contig, position) -> Column:
        return (col(contig) == self.y) & self.in_par(contig, position)

    def in_y_nonpar(self, contig, position) -> Column:
        return (col(contig) == self.y) & ~self.in_par(contig, position)

    def in_mito(self, contig) -> Column:
        return col(contig) == self.mt

    def in_autosome(self, contig) -> Column:
        return self.is_valid_contig(contig) & ~col(contig).isin([c for c in (self.x, self.y, self.mt) if c])

    def in_autosome_or_par(self, contig, position) -> Column:
        return self.in_autosome(contig) | self.in_par(contig, position)


def locus(contig, position) -> Column:
    return F.struct(col(contig).alias("contig"), col(position).cast("int").alias("position"))


def parse_locus(text) -> Column:
    t = col(text)
    return F.when(F.rlike(t, F.lit(r"^[^:]+:\d+$")), F.struct(F.regexp_extract(t, r"^([^:]+):", 1).alias("contig"), F.regexp_extract(t, r":(\d+)$", 1).cast("int").alias("position")))


def parse_variant(text) -> Column:
    """struct<locus, alleles> from contig:position:ref:alt[,alt]."""
    p = F.split(col(text), ":")
    at = lambda i: F.get(p, F.lit(i))
    return F.when(F.size(p) == 4, F.struct(F.struct(at(0).alias("contig"), at(1).cast("int").alias("position")).alias("locus"), F.concat(F.array(at(2)), F.split(at(3), ",")).alias("alleles")))


def variant_str(locus_col, alleles) -> Column:
    v, a = col(locus_col), col(alleles)
    return F.concat_ws(":", v["contig"], v["position"].cast("string"), F.get(a, F.lit(0)), F.array_join(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), ","))


def locus_window(contig, position, before: int, after: int) -> Column:
    p = col(position)
    return F.struct(F.greatest(p - before, F.lit(1)).alias("start"), (p + after).alias("end"), F.lit(True).alias("includes_start"), F.lit(True).alias("includes_end"))


def gt_indices(n_alleles) -> Column:
    n = col(n_alleles)
    return number_range(F.lit(0), (n * (n + 1) / 2).cast("int"))
