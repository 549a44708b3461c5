"""Review pages: what was masked, by which layer, for a person to check. They hold the original text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import label
from .mappings import write_secret

#: Private characters around the number of a placeholder that is still to be marked, and what stands for them in a text.
_SLOT, _OTHERS = chr(0xE002) + chr(0xE003), chr(0xE004) + chr(0xE005)
_STYLE = (
    "body{font-family:sans-serif;margin:2em;line-height:1.6}pre{background:#f4f4f4;padding:1em;white-space:pre-wrap}"
    "mark{background:#fd8;cursor:help}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}"
)


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _sources(r: Column) -> Column:
    return F.when(F.size(r["sources"]) > 0, F.array_join(r["sources"], ",")).otherwise(F.lit("-"))


def page(text: Column, masked: Column, report: Column) -> Column:
    """A page in HTML without anything from elsewhere: the masked text with each placeholder explained, a table of all
    items, and the original, folded away. Placeholders are marked from the longest on."""

    def mark(r):
        tip = F.concat(F.lit("元: "), r["original"], F.lit(" / 型: "), label(r["type"]), F.lit(" / 根拠: "), _sources(r))
        return F.concat(F.lit('<mark title="'), escaped(tip), F.lit('">'), escaped(r["token"]), F.lit("</mark>"))

    # two passes, so that a placeholder within an original isn't marked: first to a character of its own, then to its mark
    ranked = F.array_sort(F.transform(report, lambda r, i: F.struct((-F.length(r["token"])).alias("k"), i.alias("i"), r.alias("r"))))
    slot = lambda i: F.concat(F.lit(_SLOT[0]), i.cast("string"), F.lit(_SLOT[1]))
    plain = F.translate(masked, _SLOT, _OTHERS)  # a text that holds these characters shows others
    slotted = F.aggregate(ranked, escaped(plain), lambda a, o: F.replace(a, escaped(o["r"]["token"]), slot(o["i"])))
    marked = F.aggregate(ranked, slotted, lambda a, o: F.replace(a, slot(o["i"]), mark(o["r"])))
    cell = lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))
    rows = F.array_join(F.transform(report, lambda r: F.concat(F.lit("<tr>"), cell(r["token"]), cell(label(r["type"])), cell(r["original"]), cell(_sources(r)), F.lit("</tr>"))), "")
    return F.concat(
        F.lit(f'<!doctype html>\n<html lang="ja"><head><meta charset="utf-8"><title>マスク・レビュー</title><style>{_STYLE}</style></head><body><h1>マスク・レビュー</h1><p>'),
        F.size(report).cast("string"),
        F.lit(" 件をマスクしました。このページは原文を含みます。外部に出さないでください。</p><h2>マスク済みテキスト</h2><pre>"),
        marked,
        F.lit("</pre><h2>検出根拠</h2><table><tr><th>トークン</th><th>型</th><th>原文</th><th>根拠</th></tr>"),
        F.when(F.size(report) > 0, rows).otherwise(F.lit("<tr><td colspan=4>（検出なし）</td></tr>")),
        F.lit("</table><details><summary>原文</summary><pre>"),
        escaped(text),
        F.lit("</pre></details></body></html>"),
    )


def pages(masked: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, html) of masked documents."""
    return masked.select(*(keys or ("doc_id",)), page(F.col(text), F.col("masked_text"), F.col("report")).alias("html"))


def write_page(path: str, html: str) -> None:
    """One page, for its owner alone, line ends as they are."""
    write_secret(path, html)
