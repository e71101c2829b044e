"""Field extraction from web pages by rule tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogfuse.functions.text import clean_node_text

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Rule:
    """How to read one field.

    ``kind`` is 'regex' (first group of ``pattern``), 'tag' (text of ``tag[.class]`` elements, or an
    attribute of them after '@'), or 'label' (value cell next to a label cell whose text is one of
    the '|'-separated labels). Rules of one field are tried in order of ``attempt``; the first that
    finds anything wins. ``many`` collects every hit.
    """

    field: str
    pattern: str
    kind: str = "regex"
    attempt: int = 0
    many: bool = False


def _regex_value(html: Column, rule: Rule) -> Column:
    if rule.many:
        hits = F.transform(F.regexp_extract_all(html, F.lit(rule.pattern), 1), clean_node_text)
        hits = F.filter(hits, lambda h: h != "")
        return F.when(F.size(hits) > 0, hits)
    return F.nullif(clean_node_text(F.regexp_extract(html, rule.pattern, 1)), F.lit(""))


class _Reader(HTMLParser):
    """Flat list of (tag, classes, attributes, text) of one page, children's text included."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        self.nodes.append([tag, values.get("class", "").split(), values, []])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[at]][0] == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        for i in self.open:
            self.nodes[i][3].append(data)


def _text(node) -> str:
    return " ".join("".join(node[3]).split())


def _tag_hits(nodes, pattern: str) -> list[str]:
    path, _, attr = pattern.partition("@")
    tag, _, cls = path.partition(".")
    hits = [n for n in nodes if n[0] == tag and (not cls or cls in n[1])]
    values = [n[2].get(attr, "").strip() if attr else _text(n) for n in hits]
    return [v for v in values if v]


def _label_hits(nodes, pattern: str) -> list[str]:
    labels = {x.strip().lower() for x in pattern.split("|")}
    cells = [n for n in nodes if n[0] in ("td", "th", "dt", "dd", "span", "strong")]
    out = []
    for label, value in zip(cells, cells[1:]):
        if _text(label).rstrip(":：").strip().lower() in labels and _text(value):
            out.append(_text(value))
    return out


def page_hits(html: str, rules: Sequence[Rule]) -> list[list[str]]:
    """Hits of each tag or label rule on one page."""
    reader = _Reader()
    reader.feed(html or "")
    return [(_tag_hits if rule.kind == "tag" else _label_hits)(reader.nodes, rule.pattern) for rule in rules]


def read_page(html: str, rules: Sequence[Rule]) -> dict[str, list[str]]:
    """What tag and label rules find on one page: per field the hits of its first rule, by attempt, that has any."""
    out: dict[str, list[str]] = {r.field: [] for r in rules}
    for rule, hits in sorted(zip(rules, page_hits(html, rules), strict=True), key=lambda x: x[0].attempt):
        out[rule.field] = out[rule.field] or (hits if rule.many else hits[:1])
    return out


def extract_fields(
    pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", html: str = "html", all_fields: Sequence[str] = ()
) -> DataFrame:
    """One column per field, NULL when the page has no value, and ``unsupported``: the fields of
    ``all_fields`` that have no rule at all.

    A field takes the value of its first rule, by ``attempt`` whatever the kinds, that finds one. Regex rules are column
    expressions. Only when tag or label rules are given does the markup pass through a Python worker, once for all of them.
    """
    fields = list(dict.fromkeys(r.field for r in rules))
    many = {f: any(r.many for r in rules if r.field == f) for f in fields}
    walked = [r for r in rules if r.kind != "regex"]
    rows = pages.select(key, html)
    if walked:

        @F.pandas_udf(", ".join(f"w{i} array<string>" for i in range(len(walked))))
        def walk(markup: pd.Series) -> pd.DataFrame:
            found = [page_hits(page, walked) for page in markup]
            return pd.DataFrame({f"w{i}": [hits[i] or None for hits in found] for i in range(len(walked))})

        rows = rows.withColumn("_walked", walk(F.col(html)))

    def value(rule: Rule) -> Column:
        if rule.kind == "regex":
            found = _regex_value(F.col(html), rule)
            return F.when(found.isNotNull(), F.array(found)) if many[rule.field] and not rule.many else found
        hits = F.col(f"_walked.w{walked.index(rule)}")
        hits = hits if rule.many else F.slice(hits, 1, 1)
        return hits if many[rule.field] else F.get(hits, F.lit(0))

    ordered = sorted(rules, key=lambda r: r.attempt)
    columns = [F.coalesce(*[value(r) for r in ordered if r.field == f]).alias(f) for f in fields]
    missing = [f for f in all_fields if f not in fields]
    unsupported = F.array(*[F.lit(f) for f in missing]) if missing else F.array().cast("array<string>")
    return rows.select(key, *columns, unsupported.alias("unsupported"))


def page_values(class_name: str = "PageValues"):
    """Table function for user-written rules: subclass hook that yields ``(field, value)`` rows.

    Returns a ``udtf`` over (html, rule text); rule text is ``field<TAB>kind<TAB>pattern`` lines.
    """
    from pyspark.sql.functions import udtf

    class PageValues:
        def eval(self, html: str, rule_text: str):
            rules = [Rule(f, p, k, many=True) for f, k, p in (ln.split("\t") for ln in rule_text.splitlines() if ln)]
            for field, values in read_page(html, rules).items():
                for value in values:
                    yield field, value

    PageValues.__name__ = class_name
    return udtf(PageValues, returnType="field string, value string")
