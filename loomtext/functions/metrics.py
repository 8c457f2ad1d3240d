"""String, set and segmentation metrics as Catalyst expressions. NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: Column, b: Column) -> Column:
    """H1 with unit costs."""
    return F.levenshtein(a, b)


def _bigrams(x: Column) -> Column:
    n = F.length(x) - 1
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))


def dice_similarity(a: Column, b: Column) -> Column:
    """H4: of the sets of character bigrams; equal strings 1, one shorter than two characters 0."""
    x, y = _bigrams(a), _bigrams(b)
    score = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(score)


def jaccard_distance(a: Column, b: Column) -> Column:
    """H5: 0 of two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def binary_distance(a: Column, b: Column) -> Column:
    """H6: 0 of equal sets, else 1."""
    return F.when(F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)), 0.0).otherwise(1.0)


def masi_distance(a: Column, b: Column) -> Column:
    """H7: 1 - Jaccard * m, with m 1 of equal sets, 0.67 of a subset, 0.33 of overlapping ones, 0 of disjoint ones."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    m = F.when((both == F.size(x)) & (both == F.size(y)), 1.0).when(both == F.least(F.size(x), F.size(y)), 0.67).when(both > 0, 0.33).otherwise(0.0)
    return F.when(union == 0, 0.0).otherwise(1 - both / union * m)


def precision(reference: Column, test: Column) -> Column:
    """H8: share of test's items that are in reference; NULL of an empty test."""
    hits = F.size(F.filter(test, lambda x: F.array_contains(reference, x)))
    return F.when(F.size(test) > 0, hits / F.size(test))


def recall(reference: Column, test: Column) -> Column:
    """H8: share of reference's distinct items that are in test; NULL of an empty reference."""
    r = F.array_distinct(reference)
    return F.when(F.size(r) > 0, F.size(F.array_intersect(r, test)) / F.size(r))


def f_measure(reference: Column, test: Column, alpha: float = 0.5) -> Column:
    """H8: weighted harmonic mean; 0 if precision or recall is 0."""
    p, r = precision(reference, test), recall(reference, test)
    return F.when((p == 0) | (r == 0), 0.0).otherwise(1 / (alpha / p + (1 - alpha) / r))


def _ones(x: Column, boundary: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(boundary), F.lit("")))


def windowdiff(ref: Column, hyp: Column, k: int = 3, boundary: str = "1") -> Column:
    """H9: share of windows of k whose numbers of boundaries differ; NULL of unequal lengths or k beyond them, 0 at k = n."""
    n = F.length(ref)
    at = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    differ = F.size(F.filter(at, lambda i: _ones(F.substring(ref, i, F.lit(k)), boundary) != _ones(F.substring(hyp, i, F.lit(k)), boundary)))
    return F.when((n != F.length(hyp)) | (n < k), None).when(n == k, 0.0).otherwise(differ / (n - k + 1))


def pk(ref: Column, hyp: Column, k: int, boundary: str = "1") -> Column:
    """Share of windows of k of which just one side holds a boundary; NULL of unequal lengths or k beyond them."""
    n = F.length(ref)
    at = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    any_ = lambda x, i: _ones(F.substring(x, i, F.lit(k)), boundary) > 0
    return F.when((n != F.length(hyp)) | (n < k), None).otherwise(F.size(F.filter(at, lambda i: any_(ref, i) != any_(hyp, i))) / (n - k + 1))


def chance_corrected(observed: Column, expected: Column) -> Column:
    """H11, kappa and pi: 0 where the expected agreement is 1 or more."""
    return F.when(expected >= 1, 0.0).otherwise((observed - expected) / (1 - expected))


def pmi(n_ii: Column, n_ix: Column, n_xi: Column, n: Column) -> Column:
    """K9 and K5: log2 of the joint count times n over the product of the marginals."""
    return F.log2(n_ii * n / (n_ix * n_xi))


def _expected(n_ii, n_ix, n_xi, n):
    observed = [n_ii, n_ix - n_ii, n_xi - n_ii, n - n_ix - n_xi + n_ii]
    rows, cols = [n_ix, n_ix, n - n_ix, n - n_ix], [n_xi, n - n_xi, n_xi, n - n_xi]
    return [(o.cast("double"), r * c / n) for o, r, c in zip(observed, rows, cols)]


def chi_sq(n_ii: Column, n_ix: Column, n_xi: Column, n: Column) -> Column:
    """K6: over the 2 x 2 table; cells that expect nothing add nothing."""
    parts = [F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0) for o, e in _expected(n_ii, n_ix, n_xi, n)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def likelihood_ratio(n_ii: Column, n_ix: Column, n_xi: Column, n: Column) -> Column:
    """K9: G squared over the 2 x 2 table; empty cells add nothing."""
    parts = [F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0) for o, e in _expected(n_ii, n_ix, n_xi, n)]
    return 2 * (parts[0] + parts[1] + parts[2] + parts[3])


def dice(n_ii: Column, n_ix: Column, n_xi: Column) -> Column:
    return 2 * n_ii / (n_ix + n_xi)


def student_t(n_ii: Column, n_ix: Column, n_xi: Column, n: Column) -> Column:
    return (n_ii - n_ix * n_xi / n) / F.sqrt(n_ii)
