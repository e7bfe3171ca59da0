"""Public output: whitelisted markup, feeds, sitemaps; author documents; alerts."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from brightloom.functions import text as T

SAFE_LINK = re.compile(r"(?i)^(https?://|/)")
FOOTNOTE = re.compile(r"\[\^([0-9A-Za-z]+)\]:\s*(.*)")
RULE_ROW = re.compile(r"\|[\s:|-]+\|")
NEW_TAB = 'target="_blank" rel="noopener noreferrer nofollow"'


def _link(url: str, label: str) -> str:
    if not SAFE_LINK.match(url.replace("&amp;", "&")):
        return label
    return f'<a href="{url.replace(chr(34), "%22")}" {NEW_TAB}>{label}</a>'


def _spans(text: str) -> str:
    """Code, strong, emphasis and links of a line that is escaped already."""
    for pattern, tag in ((r"`([^`]+)`", "code"), (r"\*\*([^*]+)\*\*", "strong"), (r"\*([^*]+)\*", "em")):
        text = re.sub(pattern, rf"<{tag}>\1</{tag}>", text)
    return re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", lambda m: _link(m[2], m[1]), text)


def _inline(text: str) -> str:
    return re.sub(r"\[\^([0-9A-Za-z]+)\]", r'<sup class="fn-ref"><a href="#fn-\1">\1</a></sup>', _spans(text))


class _Page:
    """Blocks of a page as they are closed one after the other."""

    def __init__(self):
        self.out, self.lines, self.rows, self.kind, self.notes = [], [], [], None, []

    def end_text(self) -> None:
        """Closes an open paragraph or list."""
        if self.lines:
            self.out.append(f"<p>{'<br>'.join(map(_inline, self.lines))}</p>")
            self.lines = []
        if self.kind:
            self.out.append(f"</{self.kind}>")
            self.kind = None

    def end_table(self) -> None:
        cells = [[c.strip() for c in row.strip().strip("|").split("|")] for row in self.rows if not RULE_ROW.fullmatch(row.strip())]
        self.rows = []
        if cells:
            line = lambda row, tag: "<tr>" + "".join(f"<{tag}>{_spans(c)}</{tag}>" for c in row) + "</tr>"
            self.out.append(f"<table><thead>{line(cells[0], 'th')}</thead><tbody>{''.join(line(r, 'td') for r in cells[1:])}</tbody></table>")

    def item(self, kind: str, text: str) -> None:
        if self.lines or self.kind != kind:
            self.end_text()
            self.out.append(f"<{kind}>")
            self.kind = kind
        self.out.append(f"<li>{_inline(text)}</li>")

    def quote(self, text: str) -> None:
        self.end_text()
        if self.out and self.out[-1].startswith("<blockquote>"):
            self.out[-1] = self.out[-1].removesuffix("</blockquote>") + f"<p>{_inline(text)}</p></blockquote>"
        else:
            self.out.append(f"<blockquote><p>{_inline(text)}</p></blockquote>")

    def text(self, line: str) -> None:
        if self.kind:  # goes on in the last item of a list
            self.out[-1] = self.out[-1].removesuffix("</li>") + _inline(line) + "</li>"
        else:
            self.lines.append(line)

    def footnotes(self, urls: list[str]) -> None:
        """The notes as a list; the n-th one links to the n-th cited url if that is safe."""
        found = []
        for n, (key, text) in enumerate(self.notes):
            url = urls[n] if n < len(urls) else ""
            source = f' <a class="fn-source" href="{html.escape(url, quote=True)}" {NEW_TAB}>原文</a>' if SAFE_LINK.match(url) else ""
            found.append(f'<li id="fn-{key}">{_inline(text)}{source}</li>')
        if found:
            self.out.append(f'<section class="footnotes"><ol>{"".join(found)}</ol></section>')


def _markup(source: str | None, urls: list[str] | None = None) -> str:
    """Escapes everything, then allows headings, lists, quotes, tables, fenced code, footnotes and paragraphs."""
    page, code = _Page(), None
    for line in map(str.rstrip, html.escape(source or "", quote=False).split("\n")):
        if code is not None:
            if line == "```":
                page.out.append(f'<pre><code class="language-{code[0]}">' + "\n".join(code[1:]) + "</code></pre>")
                code = None
            else:
                code.append(line)
            continue
        plain = line.strip()
        fence, head, quote = re.fullmatch(r"```([0-9A-Za-z+-]*)", line), re.fullmatch(r"(#{1,6})\s+(.*)", line), re.match(r"&gt;\s?", line)
        bullet, number, note = re.fullmatch(r"[-*]\s+(.*)", line), re.fullmatch(r"\d+[.、]\s+(.*)", line), FOOTNOTE.fullmatch(plain)
        if not fence and plain.startswith("|") and plain.endswith("|"):
            page.end_text()
            page.rows.append(line)
            continue
        if page.rows:
            if fence:
                page.end_text()
            page.end_table()
        if fence:
            page.end_text()
            code = [fence[1]]
        elif note:
            page.end_text()
            page.notes.append(note.groups())
        elif head:
            page.end_text()
            page.out.append(f"<h{len(head[1])}>{_inline(head[2])}</h{len(head[1])}>")
        elif quote:
            page.quote(line[quote.end() :])
        elif bullet or number:
            page.item("ul" if bullet else "ol", (bullet or number)[1])
        elif not plain:
            page.end_text()
        else:
            page.text(plain)
    page.end_text()
    page.end_table()
    page.footnotes(urls or [])
    return "\n".join(page.out)


@F.pandas_udf(StringType())
def rendered_markdown(sources: pd.Series) -> pd.Series:
    """Markdown as HTML of a fixed set of elements; other markup stays visible text, links are http(s) or local only."""
    return sources.map(_markup)


@F.pandas_udf(StringType())
def rendered_article(sources: pd.Series, urls: pd.Series) -> pd.Series:
    """The same, with links from the footnotes to the urls of the article's citations, in their order."""
    return pd.Series([_markup(x, [u or "" for u in (y if y is not None else [])]) for x, y in zip(sources, urls, strict=True)])


def _xml(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def feed_items(articles: DataFrame, base: str) -> DataFrame:
    """(article_id, xml): an RSS item of each article."""
    link = F.concat(F.lit(f"{base}/article/"), F.col("article_id").cast("string"))
    return articles.select("article_id", F.concat(
        F.lit("<item><title>"), _xml(F.coalesce("title", F.lit(""))), F.lit("</title><link>"), link, F.lit("</link><guid>"), link, F.lit("</guid><pubDate>"),
        F.date_format("created_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description>"), _xml(T.first_sentence(F.col("text"))), F.lit("</description></item>"),
    ).alias("xml"))


def sitemap_urls(articles: DataFrame, base: str) -> DataFrame:
    return articles.select("article_id", F.concat(F.lit(f"<url><loc>{base}/article/"), F.col("article_id").cast("string"), F.lit("</loc><lastmod>"), F.date_format("created_at", "yyyy-MM-dd"), F.lit("</lastmod></url>")).alias("xml"))


def robots_text(mode: Column, base: str) -> Column:
    """robots.txt of a site: mode A keeps all robots out, the others let them in and name the sitemap."""
    open_ = F.lit(f"User-agent: *\nAllow: /\nSitemap: {base}/sitemap.xml\n")
    return F.when(mode == "A", "User-agent: *\nDisallow: /\n").otherwise(open_)


# fixed values: (path, kind, required) of an author document; kinds as in JSON, ``strings`` is a list of strings
AUTHOR_FIELDS = (
    ("id", "string", True), ("template", "string", True), ("version", "string", True), ("bio", "string", False), ("public_visible", "bool", False),
    ("identity.name", "string", True), ("identity.description", "string", True), ("identity.personality", "string", True), ("identity.values_stance", "string", True),
    ("identity.scenario", "string", True), ("identity.style_anchor", "string", True), ("identity.style_rules.do", "strings", True), ("identity.style_rules.dont", "strings", True),
    ("identity.style_rules.fingerprint", "strings", True), ("identity.quotes_original", "array", True), ("identity.provenance", "strings", True),
    ("route.outline.template", "string", True), ("route.outline.params", "object", True), ("route.draft.mode", "string", True), ("route.draft.params", "object", True),
    ("route.passes", "array", True), ("route.gates", "object", True), ("route.rewrite.mode", "string", True), ("route.rewrite.max_attempts", "int", True),
    ("route.rewrite.on_gate_fail", "string", True), ("route.think_routing.default", "string", True), ("memory.static_blocks", "array", True),
    ("memory.injection.max_slices_per_run", "int", True), ("memory.injection.per_block_max_chars", "int", True), ("memory.injection.selection", "string", True), ("memory.injection.position", "string", True),
    ("memory.dynamic_modules", "object", True), ("output.format", "string", True), ("output.footnote_citations", "bool", True), ("output.max_tokens_per_node", "object", False),
)
# fixed values: gates, bounds and words of an author document
GATES = ("length", "fingerprint", "echo_check", "citation", "copyright", "topic_dedup", "custom")
BOUNDS = {"route.rewrite.max_attempts": (1, 10), "memory.injection.max_slices_per_run": (0, None), "memory.injection.per_block_max_chars": (1, None)}
CHOICES = {
    "memory.injection.selection": ("round_robin", "recency", "relevant"), "memory.injection.position": ("head", "tail", "u"), "output.format": ("markdown",),
    "route.think_routing.default": ("chat", "reasoner"), "route.outline.template": ("pyramid", "variation", "sectional", "formula", "none"),
    "route.draft.mode": ("single", "rolling", "incubate", "dictate"), "route.rewrite.mode": ("gated_retry", "zero_revision"), "route.rewrite.on_gate_fail": ("revise", "record"),
}
PASSES = ("prune", "rhythm", "distort", "callback", "selfrev")
#: (gate, its field, kind, least, most) where the gate is an object.
GATE_FIELDS = (
    ("length", "min", int, 0, None), ("length", "max", int, 0, None), ("fingerprint", "min_hits", int, 0, None), ("citation", "min_count", int, 0, None),
    ("copyright", "ngram", int, 2, 64), ("topic_dedup", "recent_n", int, 0, None),
)


def _gate_errors(gates: dict, path: str) -> list[str]:
    errors = []
    for gate, name, kind, low, high in GATE_FIELDS:
        if isinstance(gates.get(gate), dict):
            value = gates[gate].get(name)
            if value is None:
                errors.append(f"{path}.{gate}.{name}: missing")
            elif not isinstance(value, kind) or isinstance(value, bool):
                errors.append(f"{path}.{gate}.{name}: not int")
            elif value < low or (high is not None and value > high):
                errors.append(f"{path}.{gate}.{name}: out of bounds")
    if isinstance(gates.get("length"), dict) and gates["length"].get("unit", "chars") not in ("chars", None):
        errors.append(f"{path}.length.unit: unknown value")
    errors += [f"{path}.echo_check: not bool"] if gates.get("echo_check") is not None and not isinstance(gates["echo_check"], bool) else []
    return errors + ([f"{path}.custom: not array"] if gates.get("custom") is not None and not isinstance(gates["custom"], list) else [])


def _pass_errors(passes: list, path: str) -> list[str]:
    errors = []
    for i, entry in enumerate(passes):
        if not isinstance(entry, dict):
            errors.append(f"{path}[{i}]: not object")
            continue
        if entry.get("type") not in PASSES:
            errors.append(f"{path}[{i}].type: {'missing' if entry.get('type') is None else 'unknown value'}")
        if not isinstance(entry.get("params") or {}, dict):
            errors.append(f"{path}[{i}].params: not object")
    return errors


def author_errors(document: str | None) -> list[str]:
    """All faults of an author document as path: what; none if it is valid."""
    try:
        root = json.loads(document or "")
    except ValueError:
        return ["$: no JSON"]
    if not isinstance(root, dict):
        return ["$: not object"]
    kinds = {"string": str, "array": list, "object": dict, "strings": list, "bool": bool, "int": int}
    errors = ["model: not allowed here"] if "model" in root else []
    for path, kind, required in AUTHOR_FIELDS:
        value, missing = root, False
        for part in path.split("."):
            if not isinstance(value, dict) or part not in value:
                missing = True
                break
            value = value[part]
        if missing or value is None:
            errors += [f"{path}: missing"] if required else []
        elif not isinstance(value, kinds[kind]) or (kind == "int" and isinstance(value, bool)) or (kind == "strings" and any(not isinstance(x, str) for x in value)):
            errors.append(f"{path}: not {kind}")
        else:
            low, high = BOUNDS.get(path, (None, None))
            if (low is not None and value < low) or (high is not None and value > high):
                errors.append(f"{path}: out of bounds")
            if path in CHOICES and value not in CHOICES[path]:
                errors.append(f"{path}: unknown value")
            if path == "template" and value not in ("single", "custom") and not value.startswith("lab:"):
                errors.append(f"{path}: unknown value")
            if path == "route.gates":
                errors += [f"{path}.{g}: missing" for g in GATES if g not in value] + [f"{path}: unknown gate {g}" for g in sorted(set(value) - set(GATES))]
                errors += _gate_errors(value, path)
            if path == "route.passes":
                errors += _pass_errors(value, path)
            if path == "memory.static_blocks":
                ids = [b.get("id") if isinstance(b, dict) else None for b in value]
                errors += [f"{path}[{i}]: {'missing id' if not x else 'repeated id'}" for i, x in enumerate(ids) if not x or x in ids[:i]]
    return errors


@F.pandas_udf(ArrayType(StringType()))
def author_document_errors(documents: pd.Series) -> pd.Series:
    return documents.map(author_errors)


def upsert_authors(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Authors merged by name: an imported document replaces that of the same name, others are added."""
    a, b = existing.select("name", F.col("document").alias("_old")), imported.select("name", F.col("document").alias("_new"))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(F.col("_old") == F.col("_new"), "same").otherwise("updated")
    return a.join(b, "name", "full_outer").select("name", F.coalesce("_new", "_old").alias("document"), change.alias("change"))


def document_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, key, before, after) of the top-level JSON members that differ between two sets of author documents."""
    members = lambda t, c: t.select("name", F.explode(F.from_json("document", "map<string,string>")).alias("key", c))
    return members(a, "before").join(members(b, "after"), ["name", "key"], "full_outer").where("NOT before <=> after")


def alert_events(changes: DataFrame) -> DataFrame:
    """(category, dedupe_key, round_id) for state changes of sources (source_id, event, round_id): a source has one key,
    so that a failure and the recovery after it are not both sent within a window."""
    rows = changes.where(F.col("event").isin("hard_failed", "suspect", "recovered"))
    category = F.when(F.col("event") == "hard_failed", "source_hard_fail").when(F.col("event") == "suspect", "source_suspect").otherwise("source_recovered")
    return rows.select(category.alias("category"), F.concat(F.lit("source-"), F.col("source_id").cast("string")).alias("dedupe_key"), "round_id")


def budget_alerts(days: DataFrame, budget: int) -> DataFrame:
    """(category, dedupe_key) of the local days (day, tokens) that used up a budget over 0."""
    return days.where(F.lit(budget > 0) & (F.col("tokens") >= budget)).select(F.lit("token_budget").alias("category"), F.concat(F.lit("daily-"), F.col("day")).alias("dedupe_key"))


def reconcile_alerts(months: DataFrame) -> DataFrame:
    """(category, dedupe_key) of the reconciled months (month, alert) that deviate too much."""
    return months.where("alert").select(F.lit("reconcile").alias("category"), F.concat(F.lit("reconcile-"), F.col("month")).alias("dedupe_key"))
