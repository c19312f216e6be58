"""Column -> Column functions: ids, labels, verdict keywords, vectors, distances."""

from functools import reduce

from pyspark.sql import Column, functions as F

from taxaspark import fixed_values as fixed


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# --- ids ---------------------------------------------------------------------

def strip_group_suffix(taxon) -> Column:
    """``SGB12_group`` -> ``SGB12``."""
    return F.regexp_replace(_col(taxon), "_group$", "")


def last_clade(clade) -> Column:
    """Last level of a ``|``-separated clade name."""
    return F.element_at(F.split(_col(clade), r"\|"), -1)


def species_from_clade(clade) -> Column:
    """``…|t__SGB12`` -> ``SGB12``; null above the species-bin level."""
    last = last_clade(clade)
    return F.when(last.startswith("t__SGB"), F.substring(last, 4, 1 << 20))


def normalise_taxon(key) -> Column:
    """``12`` or ``SGB12`` -> ``SGB12``."""
    key = _col(key)
    return F.when(key.rlike("^[0-9]+$"), F.concat(F.lit("SGB"), key)).otherwise(key)


def marker_taxon(marker) -> Column:
    """Taxon of a marker id in any of its grammars, else null.

    ``gene:12__genome`` and ``gene:SGB12__genome`` carry the taxon after the
    colon, ``SGB12__gene`` before the double underscore.
    """
    marker = _col(marker)
    after_colon = F.regexp_extract(marker, r"^[^:]*:(?:SGB)?([0-9]+)__", 1)
    leading = F.regexp_extract(marker, r"^SGB([0-9]+)__", 1)
    digits = F.coalesce(F.nullif(leading, F.lit("")), F.nullif(after_colon, F.lit("")))
    return F.concat(F.lit("SGB"), digits)


def marker_gene(marker) -> Column:
    """Gene of a marker id: before the colon, or after ``SGB12__``."""
    marker = _col(marker)
    return F.when(
        marker.rlike("^SGB[0-9]+__"), F.regexp_extract(marker, "^SGB[0-9]+__(.*)$", 1)
    ).otherwise(F.regexp_extract(marker, "^([^:]*):", 1))


def gene_of_record(record) -> Column:
    """Gene ``pNNNN`` (five characters) that ends a record id before its colon, else null."""
    gene = F.element_at(F.split(F.get(F.split(_col(record), ":"), F.lit(0)), "_"), -1)
    return F.when(gene.rlike("^p.{4}$"), gene)


def record_id(gene, genome) -> Column:
    return F.concat_ws(":", _col(gene), _col(genome))


def degap(seq) -> Column:
    return F.replace(_col(seq), F.lit("-"), F.lit(""))


# --- labels --------------------------------------------------------------------

def taxonomy_domain(taxonomy) -> Column:
    """Domain of a ``;``-separated taxonomy string."""
    first = F.trim(F.get(F.split(F.trim(_col(taxonomy)), ";"), F.lit(0)))
    name = F.regexp_replace(first, "^k__", "")
    known = F.lit(None).cast("string")
    for spelling, domain in fixed.DOMAIN_SYNONYMS.items():
        known = F.when(F.lower(name) == spelling, F.lit(domain)).otherwise(known)
    return (
        F.when(first.isNull() | (first == ""), F.lit("Unknown"))
        .when(known.isNotNull(), known)
        .otherwise(F.concat(F.lit("Unknown ("), name, F.lit(")")))
    )


def _mentions(text, words):
    return reduce(lambda acc, hit: acc | hit, [text.contains(w) for w in words])


def is_16s(description) -> Column:
    """Whether a hit description names 16S; a ruled-out word wins over a fitting one."""
    text = F.lower(_col(description))
    return _mentions(text, fixed.SIXTEEN_S_POSITIVE) & ~_mentions(text, fixed.SIXTEEN_S_NEGATIVE)


def fraction_aligned(start, end, length) -> Column:
    return F.try_divide((_col(end) - _col(start) + 1).cast("double"), _col(length))


def clean_country(geo) -> Column:
    """Display name of a place label, null for non-places and unlisted countries."""
    label = F.lower(F.trim(_col(geo)))
    country = F.trim(F.get(F.split(label, ":"), F.lit(0)))
    names = F.create_map(*[F.lit(x) for kv in fixed.COUNTRY_NAMES.items() for x in kv])
    return F.when(~label.isin(fixed.NON_PLACES), names[country])


def method_embedding(method) -> Column:
    return F.get(F.split(_col(method), "__"), F.lit(0))


def method_model(method) -> Column:
    return F.get(F.split(_col(method), "__"), F.lit(1))


def method_dimension(method) -> Column:
    """``umap_d20_s1000__…`` -> 20."""
    token = F.get(F.split(_col(method), "_"), F.lit(1))
    return F.substring(token, 2, 1 << 20).try_cast("int")


def method_mlp_depth(method) -> Column:
    depths = F.create_map(*[F.lit(x) for kv in fixed.MLP_DEPTHS.items() for x in kv])
    return depths[method_model(method)]


def method_model_type(method) -> Column:
    """Family of the prediction model."""
    model = method_model(method)
    return (
        F.when(model.contains("epc") & model.contains("_NO_MLP"), F.lit("pooled, no MLP"))
        .when(model.contains("epc"), F.lit("pooled"))
        .when(model.contains("set_transformer"), F.lit("set transformer"))
    )


def method_pooled(method) -> Column:
    """True for ``…_pool_…``, false for ``…_nopool_…``, else null."""
    method = _col(method)
    return F.when(method.contains("_pool_"), F.lit(True)).when(
        method.contains("_nopool_"), F.lit(False)
    )


def is_baseline(method) -> Column:
    method = _col(method)
    return method.contains("uniform") | method.contains("nearest_neighbor")


def embedding_model(name) -> Column:
    """Parse an embedding-model name to ``(family, dimension, seed, layers)``.

    Grammar: ``<checkpoint>[_hyena<layers>]`` (32 layers when not given),
    ``umap_d<dimension>_s<seed>``, ``pcoa_d<dimension>_s<seed>``, ``dnabert-s``.
    A name outside it raises.
    """
    name = _col(name)
    integer = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("int")
    family = (
        F.when(name.rlike("^evo-1.*$") & (F.size(F.split(name, "_hyena")) <= 2), F.lit("evo-1"))
        .when(name.rlike("^evo2.*$") & (F.size(F.split(name, "_hyena")) <= 2), F.lit("evo2"))
        .when(name == "dnabert-s", F.lit("dnabert-s"))
        .when(name.rlike("^umap_d[0-9]+_s[0-9]+$"), F.lit("umap"))
        .when(name.rlike("^pcoa_d[0-9]+_s[0-9]+$"), F.lit("pcoa"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown embedding model: "), name)))
    )
    evo = name.startswith("evo")
    return F.struct(
        family.alias("family"),
        F.when(evo, F.lit(4096)).when(name == "dnabert-s", F.lit(768))
        .otherwise(integer(r"_d([0-9]+)_s")).alias("dimension"),
        integer(r"_s([0-9]+)$").alias("seed"),
        F.when(evo, F.coalesce(integer(r"_hyena([0-9]+)$"), F.lit(32))).alias("layers"),
    )


def significance_mark(p) -> Column:
    p = _col(p)
    mark = F.when(p.isNull(), F.lit(None).cast("string"))
    for threshold, stars in fixed.SIGNIFICANCE_MARKS:
        mark = mark.when(p < threshold, F.lit(stars))
    return mark.otherwise(F.lit("n.s."))


# --- sequences and sets --------------------------------------------------------

def hamming(x, y) -> Column:
    """Number of differing positions of two equal-length strings."""
    differs = F.zip_with(
        F.split(_col(x), ""), F.split(_col(y), ""), lambda s, t: (s != t).cast("int")
    )
    return F.aggregate(differs, F.lit(0), lambda total, d: total + d)


def jaccard(x, y) -> Column:
    """|x∩y| / |x∪y| of two arrays; null when both are empty."""
    return F.try_divide(
        F.size(F.array_intersect(_col(x), _col(y))).cast("double"),
        F.size(F.array_union(_col(x), _col(y))),
    )


def jaccard_from_sizes(shared, size_a, size_b) -> Column:
    return F.try_divide(
        _col(shared).cast("double"), _col(size_a) + _col(size_b) - _col(shared)
    )


def non_gap_span(aln, ref) -> Column:
    """``(first, last)`` reference coordinate (no gaps, from 0) of an aligned fragment.

    A column counts when neither the fragment nor the reference has a gap there.
    """
    aln, ref = _col(aln), _col(ref)
    both = F.zip_with(
        F.split(aln, ""), F.split(ref, ""), lambda s, t: (s != "-") & (t != "-")
    )
    first = F.nullif(F.array_position(both, True), F.lit(0))
    last = F.length(aln) + 1 - F.nullif(F.array_position(F.reverse(both), True), F.lit(0))
    coordinate = lambda column: F.length(degap(F.substring(ref, 1, column.cast("int")))) - 1
    return F.struct(coordinate(first).alias("first"), coordinate(last).alias("last"))


# --- divergence terms (sum them per sample or pair) -----------------------------

def xlogx(x) -> Column:
    x = _col(x)
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def kl_term(p, q) -> Column:
    """One term of KL(p‖q); zero where p is zero."""
    p, q = _col(p), _col(q)
    return F.when(p > 0, p * (F.ln(p) - F.ln(q))).otherwise(F.lit(0.0))


def jensen_shannon_term(p, q) -> Column:
    """One term of the Jensen–Shannon divergence (natural log, not rooted)."""
    p, q = _col(p), _col(q)
    return 0.5 * (xlogx(p) + xlogx(q) - xlogx(p + q) + (p + q) * F.ln(F.lit(2.0)))


def similarity_from_distance(d, d_max) -> Column:
    return 1 - F.try_divide(_col(d), _col(d_max))


def distance_kernel(d) -> Column:
    return F.exp(-_col(d))


def geometric_mean(x, eps=None) -> Column:
    """Aggregate: geometric mean of the non-zero entries, or with ``eps`` inside the log."""
    x = _col(x)
    if eps is None:
        return F.exp(F.avg(F.when(x > 0, F.ln(x))))
    return F.exp(F.avg(F.ln(x + F.lit(eps))))


# --- vectors -------------------------------------------------------------------

def pad_vector(vec, size) -> Column:
    """Zero-pad an array of numbers to ``size`` entries; longer arrays stay as they are."""
    vec = _col(vec).cast("array<double>")
    size = F.lit(size) if isinstance(size, int) else size
    missing = F.greatest(size - F.size(vec), F.lit(0))
    return F.concat(vec, F.array_repeat(F.lit(0.0), missing))


def standardise_vector(vec, mean, scale) -> Column:
    centred = F.zip_with(_col(vec).cast("array<double>"), _col(mean), lambda x, m: x - m)
    return F.zip_with(centred, _col(scale), lambda x, s: x / s)


def has_nan(vec) -> Column:
    return F.exists(_col(vec), lambda x: F.isnan(x))
