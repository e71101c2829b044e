"""Names of people and facts about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogfuse.functions.basics import as_col, distinct_in_order, let, literal_map

# Separators between names, and entries that stand for no name.
NAME_SEPARATORS = "[|｜,，/／、]"
NO_NAME = ("-", "_")


def clean_people(c: Column | str, placeholders: Sequence[str] = NO_NAME) -> Column:
    """Names of a text: split, the bracketed alternative preferred, placeholders out, distinct in order."""
    names = F.transform(F.split(as_col(c), NAME_SEPARATORS), lambda x: F.trim(x))
    names = F.filter(names, lambda n: ~n.isin(*placeholders))
    bracket = "[（(]\\s*([^()（）]+?)\\s*[）)]"
    inner = lambda n: F.trim(F.regexp_extract(n, bracket, 1))
    return distinct_in_order(F.transform(names, lambda n: F.when(inner(n) != "", inner(n)).otherwise(n)))


def exclude_people(names: Column | str, excluded: Column | Sequence[str]) -> Column:
    """Names without the excluded ones, order kept."""
    banned = excluded if isinstance(excluded, Column) else F.array(*[F.lit(x) for x in excluded])
    return F.filter(as_col(names), lambda n: ~F.array_contains(banned, n))


def only_own_tags(tags: Column | str, names: Column | str) -> Column:
    """Tags without those holding a person's name or a colon."""
    names = F.filter(as_col(names), lambda n: n != "")
    return F.filter(
        as_col(tags),
        lambda t: ~(F.exists(names, lambda n: t.contains(n)) | t.contains(":") | t.contains("：") | (t == "")),
    )


def birth_date(text: Column | str, labels: Sequence[str], pattern: str = "(\\d+)年(\\d+)月(\\d+)日") -> Column:
    """Birth date from ``label: value`` lines; two-digit years are 19xx, other short years 1970."""
    line = F.element_at(
        F.concat(
            F.filter(
                F.split(as_col(text), "\n"),
                lambda s: F.substring_index(s, ":", 1).rlike("|".join(labels)) & s.rlike(pattern),
            ),
            F.array(F.lit("")),
        ),
        1,
    )
    year, month, day = (F.regexp_extract(line, pattern, i) for i in (1, 2, 3))
    full_year = F.when(F.length(year) == 4, year).when(F.length(year) == 2, F.concat(F.lit("19"), year)).otherwise("1970")
    two = lambda c: F.when(F.length(c) == 2, c).otherwise(F.concat(F.lit("0"), c))
    return F.when(line != "", F.concat_ws("-", full_year, two(month), two(day)))


def birth_place(text: Column | str, labels: Sequence[str], country: str = "", joiner: str = "·") -> Column:
    """First place name of the birthplace line, prefixed by its country; NULL when it is only the country."""
    lines = F.filter(F.split(as_col(text), "\n"), lambda s: F.substring_index(s, ":", 1).rlike("|".join(labels)))
    value = F.trim(F.regexp_replace(F.element_at(F.concat(lines, F.array(F.lit(""))), 1), "^[^:]*:", ""))
    place = F.regexp_extract(value, "[^ →]+", 0)
    if not country:
        return F.nullif(place, F.lit(""))
    bare = F.regexp_replace(place, f"\\Q{country}\\E[・·]?", "")
    return F.when((place != "") & (place != country), F.concat(F.lit(country + joiner), bare))


def person_tags(
    height: Column | str, bust: Column | str, waist: Column | str, hip: Column | str, birthday: Column | str,
    career: Column | str, as_of_year: int, names: dict[str, str] | None = None,
) -> Column:
    """Attribute tags of a person; ``as_of_year`` fixes the age so that reruns agree."""
    label = {
        "height": "height", "measures": "measures", "born": "born", "age": "age", "career": "career", **(names or {}),
    }
    height, bust, waist, hip, birthday, career = map(as_col, (height, bust, waist, hip, birthday, career))
    some = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def tag(kind: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label[kind]}: "), value)

    age = (F.lit(as_of_year) - F.substring(birthday, 1, 4).try_cast("int")).cast("string")
    return F.array_compact(
        F.array(
            F.when(some(height), tag("height", text(height))),
            F.when(some(bust) | some(waist) | some(hip), tag("measures", F.concat_ws("/", text(bust), text(waist), text(hip)))),
            F.when(some(birthday), tag("born", F.substring(birthday, 1, 10))),
            F.when(some(birthday), tag("age", age)),
            F.when(some(career), tag("career", F.replace(F.replace(F.replace(career, F.lit("年"), F.lit("")), F.lit(" "), F.lit("")), F.lit("-"), F.lit("~")))),
        )
    )


def account_id(url: Column | str, host: str) -> Column:
    """Account name after ``host/`` in a profile address."""
    return F.nullif(F.regexp_extract(as_col(url), f"\\Q{host}\\E/(.*)", 1), F.lit(""))


def provider_ids(claims_json: Column | str, entity: Column | str, properties: Sequence[tuple[str, str]]) -> Column:
    """Provider -> id map from entity-claims JSON, in the given order.

    Reading stops at the first property the entity lacks, as each lookup depends on the one before.
    """
    doc = as_col(claims_json)
    values = []
    for _, prop in properties:
        path = F.concat(F.lit("$.entities."), as_col(entity), F.lit(f".claims.{prop}[0].mainsnak.datavalue.value"))
        values.append(F.call_function("get_json_object", doc, path))

    def known(found: Column) -> Column:
        entries, seen_all = [], F.lit(True)
        for i, (name, _) in enumerate(properties):
            seen_all = seen_all & found[i].isNotNull()
            entries.append(F.when(seen_all, F.struct(F.lit(name).alias("key"), found[i].alias("value"))))
        return F.map_from_entries(F.array_compact(F.array(*entries)))

    return let(F.array(*values), known)


def description(
    claims_json: Column | str, entity: Column | str, language: str, fallback: dict[str, str] | None = None,
    fallback_language: str = "en",
) -> Column:
    """Description in one language, else a dictionary translation of the fallback language's text."""
    doc = as_col(claims_json)

    def of(lang: str) -> Column:
        path = F.concat(F.lit("$.entities."), as_col(entity), F.lit(f".descriptions.{lang}.value"))
        return F.call_function("get_json_object", doc, path)

    own = F.nullif(of(language), F.lit(""))
    return F.coalesce(own, literal_map(fallback)[of(fallback_language)]) if fallback else own


def needs_person_lookup(
    people: Column | str, item_type: Column | str, always: Sequence[str], when_unknown: Sequence[str], unknown: str
) -> Column:
    """Types looked up always; types looked up only when people are missing or the placeholder."""
    names = distinct_in_order(people)
    missing = (F.coalesce(F.size(names), F.lit(0)) <= 0) | ((F.size(names) == 1) & (names[0] == unknown))
    kind = as_col(item_type)
    return F.when(kind.isin(*when_unknown), missing).otherwise(kind.isin(*always))
