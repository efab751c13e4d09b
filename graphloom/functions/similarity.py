"""Label similarity, set similarity and numeric helpers, all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: URL prefixes with a short name each; what follows one is a node's short label.
URI_PREFIXES = (("http://dbpedia.org/resource/", "dbp_uri_"), ("http://dbpedia.org/ontology/", "dbp_uri_"), ("http://rdf.freebase.com/ns/", "frb_uri_"))


def lev_norm(a: Column, b: Column) -> Column:
    """1 - case-folded edit distance / longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(F.lower(a), F.lower(b)) / longest).otherwise(F.lit(1.0))


def node_terms(labels: str = "labels", props: str = "props") -> Column:
    """What is compared of a node: its labels, or the values of its properties if it has none."""
    return F.when(F.size(labels) > 0, F.col(labels)).otherwise(F.map_values(props))


def label_similarity(query: Column, terms: Column) -> Column:
    """Mean over a node's terms of their positive similarity to the query label; 0 without terms."""
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.greatest(F.lit(0.0), lev_norm(query, t)))
    return F.when(F.size(terms) > 0, total / F.size(terms)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; two empty ones give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


# The modulus of the hash family, 2**31 - 1, and the generator of its coefficients.
MERSENNE, GENERATOR = 2_147_483_647, 48_271


def minhash_family(hashes: int) -> list[tuple[int, int]]:
    """Coefficients (a, b) of ``hashes`` affine permutations modulo 2**31 - 1."""
    values, x = [], 12_345
    for _ in range(2 * hashes):
        x = x * GENERATOR % MERSENNE
        values.append(x)
    return list(zip(values[::2], values[1::2], strict=True))


def minhash(items: Column, hashes: int = 100) -> Column:
    """Signature of a set: per affine permutation of its items' digests the least value; of an empty set nulls."""
    digests = F.transform(items, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))

    def least(d: Column, a: int, b: int) -> Column:
        return F.array_min(F.transform(d, lambda x: (x * F.lit(a) + F.lit(b)) % F.lit(MERSENNE)))

    # Bound to a lambda's variable, so that digests are taken once, not for each permutation.
    return F.get(F.transform(F.array(digests), lambda d: F.array(*[least(d, a, b) for a, b in minhash_family(hashes)])), F.lit(0))


def minhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal signature values, an estimate of the Jaccard index with error 1 / sqrt(length)."""
    both = F.array(F.struct(a.alias("a"), b.alias("b")))  # bound to a lambda's variable, so that signatures are taken once
    return F.get(F.transform(both, lambda p: F.size(F.filter(F.zip_with(p["a"], p["b"], lambda x, y: x == y), lambda x: x)) / F.size(p["a"])), F.lit(0))


def short_uri(uri: Column) -> Column:
    """A URI's short name: past a known prefix, else the host without ``www.``; null if it has neither."""
    known = reduce(lambda e, p: F.when(uri.startswith(p[0]), F.concat(F.lit(p[1]), F.substr(uri, F.lit(len(p[0]) + 1)))).otherwise(e), reversed(URI_PREFIXES), F.lit(None).cast("string"))
    return F.coalesce(known, F.regexp_replace(F.nullif(F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1), F.lit("")), r"^www\.", ""))


def prefixed(labels: Column, prefix: str) -> Column:
    """Every label with a prefix, as nodes of one source are relabelled."""
    return F.transform(labels, lambda x: F.concat(F.lit(prefix), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scaled(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def kept_of(n: int) -> int:
    """How many of n repeated timings count: one less of 2 or 3, 3 of 5, 4 of 7, five less beyond."""
    return {1: 1, 2: 1, 3: 2, 4: 3, 5: 3, 6: 4, 7: 4}.get(n, n - 5)


def trimmed_mean(times: Column) -> Column:
    """Mean of the smallest timings of an array, by the rule of ``kept_of``."""
    n = F.size(times)
    keep = reduce(lambda e, k: F.when(n == k, F.lit(kept_of(k))).otherwise(e), range(1, 8), n - 5)
    return F.aggregate(F.slice(F.array_sort(times), 1, keep), F.lit(0.0), lambda s, x: s + x) / keep


def trimmed_mean_of(times: Sequence[float]) -> float:
    keep = kept_of(len(times))
    return sum(sorted(times)[:keep]) / keep


def kth_smallest(values: Column, k: int) -> Column:
    """The k-th smallest item of an array, from 1; null beyond its end."""
    return F.try_element_at(F.array_sort(values), F.lit(k))
