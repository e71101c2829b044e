"""Field-by-field fusion of source observations.

An *observation* is one source's record of one item. Every source has a rank per field; the fused
value of a field is that of the best-ranked source with a valid value. All fusion here is grouped
aggregation with map-side combining, so an item that owns a large share of the rows costs one
partial result per task, not one straggler.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from catalogfuse.functions.basics import distinct_in_order
from catalogfuse.functions.values import is_zero_runtime, normalize_release, normalize_year
from catalogfuse.schemas import FUSED_FIELDS, PRIORITY, Field

KEY = "item_code"
# A field's state in an observation.
LETTERS = VALID, INVALID, MISSING = "vim"


def item_keys(obs: DataFrame) -> list[str]:
    """What an item is known by: ranks differ by type, so an item of two types is two."""
    return [KEY, "item_type"] if "item_type" in obs.columns else [KEY]


def present(field: Field) -> Column:
    """The source supplied something for the field."""
    c = F.col(field.name)
    if field.kind == "list":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(c.cast("string") != "", F.lit(False))


def valid_value(field: Field) -> Column:
    """The value to fuse, NULL when missing or invalid.

    A score of 0 counts as missing. (Seeding the result with a truthy '0.0' would mean scores are
    never fused at all.)
    """
    c = F.col(field.name)
    if field.kind == "list":
        return F.when(F.size(c) > 0, c)
    text = F.nullif(c.cast("string"), F.lit(""))
    if field.kind == "release":
        return normalize_release(text)
    if field.kind == "runtime":
        return F.when(~is_zero_runtime(text), text)
    if field.kind == "year":
        return normalize_year(text, F.lit(None).cast("string"))
    if field.kind == "score":
        return F.when(F.coalesce(text.try_cast("double"), F.lit(1.0)) != 0, text)
    return text


def priority_frame(spark, rows: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """Priority table from driver-side configuration; a table of the same columns serves as well."""
    return spark.createDataFrame(list(rows), PRIORITY)


def resolve_priorities(
    type_sources: DataFrame, field_sources: DataFrame, fields: Sequence[str], overrides: DataFrame | None = None
) -> DataFrame:
    """Source order per (item_type, field).

    ``type_sources(item_type, source, rank)``, ``field_sources(field, source, rank)``. A field's
    sources are those also listed for the type, in field order; when none is left, the type's own
    order. ``overrides(item_type, field, source, rank)`` replace a field's list and are cut to the
    type's sources again, with no fallback. These are configuration tables.
    """
    types = type_sources.select("item_type", "source", F.col("rank").alias("t_rank"))
    by_field = field_sources.where(F.col("field").isin(*fields))
    by_field = by_field.select("field", "source", F.col("rank").alias("f_rank"))
    hits = types.join(by_field, "source").select("item_type", "field", "source", F.col("f_rank").alias("o"))
    every_field = F.explode(F.array(*[F.lit(f) for f in fields])).alias("field")
    slots = types.select("item_type").distinct().select("item_type", every_field)
    empty = slots.join(hits.select("item_type", "field").distinct(), ["item_type", "field"], "left_anti")
    spare = empty.join(types, "item_type").select("item_type", "field", "source", F.col("t_rank").alias("o"))
    merged = hits.unionByName(spare)
    if overrides is not None:
        named = overrides.select("item_type", "field").distinct()
        own = overrides.join(types.select("item_type", "source"), ["item_type", "source"], "left_semi")
        merged = merged.join(named, ["item_type", "field"], "left_anti").unionByName(
            own.select("item_type", "field", "source", F.col("rank").alias("o"))
        )
    order = W.partitionBy("item_type", "field").orderBy("o", "source")
    return merged.select("item_type", "field", "source", F.row_number().over(order).alias("rank"))


def _rank_table(priority: DataFrame, fields: Sequence[Field], typed: bool) -> DataFrame:
    """The priority table as one row per (item_type, source) with an ARRAY<INT> of ranks per field."""
    keys = ["item_type", "source"] if typed else ["source"]
    ranks = F.array(*[F.min(F.when(F.col("field") == f.name, F.col("rank"))) for f in fields])
    return priority.where(F.col("field").isin(*[f.name for f in fields])).groupBy(*keys).agg(ranks.alias("_ranks"))


def _with_ranks(obs: DataFrame, priority: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Observations with an ARRAY<INT> of ranks per field; rows of unranked sources are dropped.

    The priority table is pivoted to one row per (item_type, source), so the join is on a table of
    (types x sources) rows. It carries no hint: the optimizer broadcasts it by its real size.
    """
    typed = "item_type" in obs.columns
    out = obs.join(_rank_table(priority, fields, typed), ["item_type", "source"] if typed else ["source"])
    if _by_language(obs, fields):
        lang = F.coalesce(F.col("language"), F.lit(""))
        allowed = [
            F.when((lang == "") | (lang == (f.language or "")), F.col("_ranks")[i]) for i, f in enumerate(fields)
        ]
        out = out.withColumn("_ranks", F.array(*allowed))
    return out.where(F.exists("_ranks", lambda r: r.isNotNull()))


def _by_language(obs: DataFrame, fields: Sequence[Field]) -> bool:
    return "language" in obs.columns and any(f.language for f in fields)


def one_per_source(
    obs: DataFrame, order: Sequence[str], extra_keys: Sequence[str] = (), keep: Sequence[str] | None = None
) -> DataFrame:
    """First observation of each (item, source) by ``order``; combines before it shuffles. Only the columns ``keep`` (all) travel."""
    keys = [KEY, "source", *extra_keys]
    rest = [c for c in (obs.columns if keep is None else keep) if c not in keys]
    picked = obs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _first_ranked(
    obs: DataFrame, priority: DataFrame, fields: Sequence[Field], order: Sequence[str], extra_keys: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """``one_per_source`` of the ranked rows, with their ``_ranks``. Ranks that are the same for a source's rows join in afterwards."""
    if _by_language(obs, fields):
        return one_per_source(_with_ranks(obs, priority, fields), order, extra_keys, [*keep, "_ranks"])
    typed = ["item_type"] if "item_type" in obs.columns else []
    ranks = _rank_table(priority, fields, bool(typed)).where(F.exists("_ranks", lambda r: r.isNotNull()))
    ranked = obs.join(ranks.select(*typed, "source"), [*typed, "source"], "left_semi")
    return one_per_source(ranked, order, extra_keys, [*typed, *keep]).join(ranks, [*typed, "source"])


def _with_values(ranked: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Valid values as columns ``_v_<field>``, computed once per row."""
    return ranked.withColumns({f"_v_{f.name}": valid_value(f) for f in fields})


def _winners(fields: Sequence[Field], with_id: bool) -> list[Column]:
    out = []
    for i, f in enumerate(fields):
        value, rank = F.col(f"_v_{f.name}"), F.col("_ranks")[i]
        parts = [rank.alias("rank"), F.col("source").alias("source"), value.alias("value")]
        if with_id:
            parts.append(F.col("external_id").alias("external_id"))
        out.append(F.min(F.when(value.isNotNull() & rank.isNotNull(), F.struct(*parts))).alias(f"_w_{f.name}"))
    return out


def fuse_fields(
    obs: DataFrame,
    priority: DataFrame,
    fields: Sequence[Field] = FUSED_FIELDS,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """One row per item: fused fields, ``field_sources`` and ``external_ids`` maps.

    * a value is valid when non-empty, and: a runtime is not all zero, a release is a calendar date
      (its ISO form is stored), a score is not 0;
    * an invalid value falls through to the next source;
    * ``external_ids`` holds only sources that supplied a fused value;
    * ``year`` comes from the release when no source has a valid one;
    * ``all_people`` ends with the ``people`` it lacks;
    * an item seen as several types is fused once for each;
    * an item with no ranked source gets no row.

    Observations are taken as unique per (item, source); pass ``order`` to keep the first of several.
    """
    fields = [f for f in fields if f.name in obs.columns]
    with_id = "external_id" in obs.columns
    if order:
        keep = [*[f.name for f in fields], *(["external_id"] if with_id else [])]
        ranked = _first_ranked(obs, priority, fields, order, ["language"] if "language" in obs.columns else [], keep)
    else:
        ranked = _with_ranks(obs, priority, fields)
    keys = item_keys(obs)
    fused = _with_values(ranked, fields).groupBy(*keys).agg(*_winners(fields, with_id))
    return fused.select(*keys, *_fused_columns(fields, with_id))


def _fused_columns(fields: Sequence[Field], with_id: bool) -> list[Column]:
    win = {f.name: F.col(f"_w_{f.name}") for f in fields}
    values = {n: w["value"] for n, w in win.items()}
    if "release" in win:
        from_release = F.substring(win["release"]["value"], 1, 4)
        values["year"] = F.coalesce(values["year"], from_release) if "year" in win else from_release
    if "people" in win and "all_people" in win:
        none = F.array().cast("array<string>")
        both = F.array_distinct(F.concat(F.coalesce(values["all_people"], none), F.coalesce(values["people"], none)))
        values["all_people"] = F.when(F.size(both) > 0, both)
    cols = [v.alias(n) for n, v in values.items()]
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), w["source"].alias("value")) for n, w in win.items()])
    cols.append(F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("field_sources"))
    if with_id:
        ids = F.array(*[F.struct(w["source"].alias("key"), w["external_id"].alias("value")) for w in win.values()])
        # A source that supplied several fields under different ids keeps that of the last field.
        ids = F.filter(ids, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
        last = F.transform(F.array_distinct(F.transform(ids, lambda p: p["key"])), lambda k: F.element_at(F.filter(ids, lambda p: p["key"] == k), -1))
        cols.append(F.map_from_entries(last).alias("external_ids"))
    return cols


def _collected(obs, priority, fields, order, payload: Sequence[str], try_all: Sequence[str]) -> DataFrame:
    """Per item: winning ranks and one entry per source.

    ``one_per_source`` runs first, so a group holds at most as many entries as there are ranked
    sources: the list is bounded by the priority table, not by the data.
    """
    more = [c for c in ("item_type", "language") if c in obs.columns]
    # A letter per field is all that travels of values that are only asked whether they are valid.
    letters = [F.when(valid_value(f).isNotNull(), VALID).when(present(f), INVALID).otherwise(MISSING) for f in fields]
    coded = obs.withColumn("_state", F.concat(*letters))
    ranked = _first_ranked(coded, priority, fields, order, more, ["_state", *payload])
    entry = F.struct("source", F.col("_ranks").alias("ranks"), F.col("_state").alias("state"), *payload)
    wins = [
        F.lit(None).cast("int")
        if f.name in try_all
        else F.min(F.when(F.substring("_state", i + 1, 1) == VALID, F.col("_ranks")[i]))
        for i, f in enumerate(fields)
    ]
    return ranked.groupBy(*item_keys(obs)).agg(F.array(*wins).alias("_wins"), F.collect_list(entry).alias("_entries"))


def _touch(entry: Column, wins: Column, n_fields: int) -> Column:
    """Where a source is first consulted: smallest (field index, rank); NULL when it never is.

    For each field sources are asked in rank order up to the first valid value.
    """
    spots = F.transform(
        F.sequence(F.lit(0), F.lit(n_fields - 1)),
        lambda i: F.when(
            F.get(entry["ranks"], i) <= F.coalesce(F.get(wins, i), F.lit(2**31 - 1)),
            F.struct(i.alias("field"), F.get(entry["ranks"], i).alias("rank")),
        ),
    )
    return F.array_min(spots)


def collect_candidates(
    obs: DataFrame,
    priority: DataFrame,
    fields: Sequence[Field] = FUSED_FIELDS,
    order: Sequence[str] = ("external_id",),
    try_all: Sequence[str] = (),
    edition: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Asset and people candidates of every item, from the sources that were consulted.

    A source is consulted for a field only up to the field's first valid value; the order of
    consultation is first appearance in (field order, rank order). ``try_all`` names fields whose
    sources are all consulted. Returns ``consulted``, ``thumbs`` and ``posters`` (source, url; posters
    in poster-priority order), ``people_union`` and ``edition`` (the first that is not empty once the function
    ``edition`` has normalised it). A source with rows in several languages is consulted once, for all of them.
    """
    if edition is not None and "edition" in obs.columns:
        obs = obs.withColumn("edition", edition(F.col("edition")))
    fields = [f for f in fields if f.name in obs.columns]
    payload = [c for c in ("thumb", "poster", "people", "edition") if c in obs.columns]
    grouped = _collected(obs, priority, fields, order, payload, try_all)
    touched = F.transform(
        "_entries", lambda e: F.struct(_touch(e, F.col("_wins"), len(fields)).alias("at"), e.alias("e"))
    )
    asked = F.array_sort(F.filter(touched, lambda t: t["at"].isNotNull()))
    keys = item_keys(obs)
    base = grouped.select(*keys, asked.alias("_asked"))

    def assets(entries: Column, name: str) -> Column:
        got = F.filter(entries, lambda t: F.coalesce(t["e"][name] != "", F.lit(False)))
        return F.array_distinct(
            F.transform(got, lambda t: F.struct(t["e"]["source"].alias("source"), t["e"][name].alias("url")))
        )

    out = [*map(F.col, keys), F.array_distinct(F.transform("_asked", lambda t: t["e"]["source"])).alias("consulted")]
    if "thumb" in payload:
        out.append(assets(F.col("_asked"), "thumb").alias("thumbs"))
    if "poster" in payload:
        slot = [f.name for f in fields].index("poster")
        ranked = F.filter("_asked", lambda t: t["e"]["ranks"][slot].isNotNull())
        by_rank = F.array_sort(F.transform(ranked, lambda t: F.struct(t["e"]["ranks"][slot].alias("r"), t["e"].alias("e"))))
        out.append(assets(by_rank, "poster").alias("posters"))
    if "people" in payload:
        names = F.flatten(F.transform("_asked", lambda t: F.coalesce(t["e"]["people"], F.array().cast("array<string>"))))
        out.append(distinct_in_order(names).alias("people_union"))
    if "edition" in payload:
        first = F.filter("_asked", lambda t: F.coalesce(t["e"]["edition"] != "", F.lit(False)))
        out.append(F.get(F.transform(first, lambda t: t["e"]["edition"]), F.lit(0)).alias("edition"))
    return base.select(*out)


def field_coverage(
    obs: DataFrame,
    priority: DataFrame,
    fields: Sequence[Field] = FUSED_FIELDS,
    order: Sequence[str] = ("external_id",),
) -> DataFrame:
    """How often each source was chosen, missing, invalid or not asked, per field."""
    fields = [f for f in fields if f.name in obs.columns]
    grouped = _collected(obs, priority, fields, order, [], ())
    names = F.array(*[F.lit(f.name) for f in fields])
    states = F.array(F.lit("valid"), F.lit("invalid"), F.lit("missing"))

    def status(e: Column, i: Column) -> Column:
        rank = F.get(e["ranks"], i)
        win = F.get(F.col("_wins"), i)
        return F.struct(
            F.get(names, i).alias("field"),
            e["source"].alias("source"),
            F.when(rank.isNull(), F.lit(None).cast("string"))
            .when(rank > win, "not_asked")
            .when(rank == win, "chosen")
            .otherwise(F.get(states, F.call_function("instr", F.lit(LETTERS), F.substring(e["state"], i + 1, F.lit(1))) - 1))
            .alias("status"),
        )

    spots = F.sequence(F.lit(0), F.lit(len(fields) - 1))
    rows = F.flatten(F.transform("_entries", lambda e: F.transform(spots, lambda i: status(e, i))))
    long = grouped.select(F.inline(rows)).where(F.col("status").isNotNull())
    return long.groupBy("field", "source", "status").agg(F.count(F.lit(1)).alias("n"))


def fuse_first_source(
    obs: DataFrame, source_order: DataFrame, has_data: Column | None = None, log_skipped: bool = False
) -> DataFrame:
    """Whole record of the first source with data. ``source_order(source, rank[, item_type])``.

    ``log_skipped`` adds the sources tried before the winner; it is bounded by the source list.
    """
    has_data = F.coalesce(F.col("title") != "", F.lit(False)) if has_data is None else has_data
    keys = ["item_type", "source"] if "item_type" in source_order.columns else ["source"]
    ranked = obs.join(source_order.select(*keys, F.col("rank").alias("_rank")), keys)
    columns = [c for c in obs.columns if c != KEY]
    first = F.min_by(F.struct("_rank", *columns), F.when(has_data, F.col("_rank"))).alias("_r")
    aggs = [first]
    if log_skipped:
        aggs.append(F.collect_set(F.struct("_rank", "source")).alias("_tried"))
    out = ranked.groupBy(KEY).agg(*aggs).where(F.col("_r").isNotNull())
    cols = [F.col(KEY), *[F.col(f"_r.{c}").alias(c) for c in columns]]
    if log_skipped:
        before = F.filter("_tried", lambda t: t["_rank"] < F.col("_r._rank"))
        cols.append(F.transform(F.array_sort(before), lambda t: t["source"]).alias("skipped"))
    return out.select(*cols)


def fuse_single_source(obs: DataFrame, source: str, fields: Sequence[Field] = FUSED_FIELDS) -> DataFrame:
    """Records of one forced source, cleaned like fused ones."""
    fields = [f for f in fields if f.name in obs.columns]
    rest = [c for c in obs.columns if c not in {f.name for f in fields}]
    return obs.where(F.col("source") == source).select(*rest, *[valid_value(f).alias(f.name) for f in fields])


def merge_by_category(
    obs: DataFrame,
    categories: Sequence[str],
    fields: Sequence[Field],
    stream_only: Sequence[str] = (),
    dates: Sequence[str] = ("release", "year"),
    seq: str = "seq",
) -> DataFrame:
    """Overlay records of one source's categories, low to high; later rows win inside a category.

    Stream-only categories do not set dates, but their first date fills in when no other is known,
    higher category first.
    """
    rank_of = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, i)])
    base = obs.withColumn("_cat", rank_of[F.col("category")]).where(F.col("_cat").isNotNull())
    base = _with_values(base, fields)
    streaming = F.col("category").isin(*stream_only) if stream_only else F.lit(False)
    aggs = []
    for f in fields:
        value = F.col(f"_v_{f.name}")
        use = value.isNotNull() & (~streaming if f.name in dates else F.lit(True))
        aggs.append(F.max_by(value, F.when(use, F.struct("_cat", seq))).alias(f.name))
        if f.name in dates and stream_only:
            spare = F.when(value.isNotNull() & streaming, F.struct((-F.col("_cat")).alias("c"), F.col(seq).alias("s")))
            aggs.append(F.min_by(value, spare).alias(f"_s_{f.name}"))
    out = base.groupBy(KEY).agg(*aggs)
    cols = [
        F.coalesce(F.col(f.name), F.col(f"_s_{f.name}")).alias(f.name)
        if f.name in dates and stream_only
        else F.col(f.name)
        for f in fields
    ]
    return out.select(KEY, *cols)


def overlay_valid(base: DataFrame, patch: DataFrame, key: str = KEY) -> DataFrame:
    """Base rows with every valid patch value laid over; columns unknown to the base are dropped."""
    shared = [c for c in base.columns if c in patch.columns and c != key]
    lists = {f.name for f in base.schema.fields if isinstance(f.dataType, T.ArrayType)}
    texts = {f.name for f in base.schema.fields if isinstance(f.dataType, T.StringType)}
    right = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in shared])

    def merged(c: str) -> Column:
        new = F.col(f"_p_{c}")
        if c in texts:
            new = F.nullif(new, F.lit(""))
        elif c in lists:
            new = F.when(F.size(new) > 0, new)
        return F.coalesce(new, F.col(c)).alias(c)

    joined = base.join(right, key, "left")
    return joined.select(*[merged(c) if c in shared else F.col(c) for c in base.columns])
