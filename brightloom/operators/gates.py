"""Gates over drafted texts: length, style words, echo, reuse of blocks, topic, rhythm, citations."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brightloom.config import DEFAULTS
from brightloom.functions import text as T
from brightloom.functions import urls as U
from brightloom.storage import stored

# fixed value: what stands for a memory module without entries
NO_MEMORY = "（暂无记录）"
# fixed value: pairs of characters up to which two texts are compared on one grid of bits (128 KB)
GRID_CELLS = 1 << 20


def length_issue(text: Column, low: int = 0, high: int = 10**9) -> Column:
    """struct(chars, issue): characters without footnotes and blanks; an issue outside of the bounds."""
    issue = lambda n: F.when(n < low, F.concat(n.cast("string"), F.lit(f" < {low}"))).when(n > high, F.concat(n.cast("string"), F.lit(f" > {high}")))
    return T.bound(F.length(T.clean_text(text)), lambda n: F.struct(n.alias("chars"), issue(n).alias("issue")))


def style_hits(text: Column, words: list[str]) -> Column:
    """The lexicon words that the clean text holds, in the lexicon's order."""
    return T.bound(T.clean_text(text), lambda clean: F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(clean, w)))


def echo_source(anchor: Column) -> Column:
    """The anchor without blank lines and without lines of instructions in brackets."""
    lines = F.transform(F.split(anchor, r"\r?\n"), lambda x: T.strip(x))
    return F.array_join(F.filter(lines, lambda s: (s != "") & ~s.startswith("【") & ~s.startswith("（续") & ~s.startswith("(")), "")


def echoes(text: Column, anchor: Column, n: int = DEFAULTS.echo_min_chars) -> Column:
    """Whether text and anchor share a run of at least n characters: a shared n-gram. JVM-side."""
    return F.arrays_overlap(F.array_distinct(T.ngrams(T.clean_text(text), n)), F.array_distinct(T.ngrams(echo_source(anchor), n)))


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common substring of two clean texts, by prefix doubling; JVM-side.

    Every place of a text gets a name, a 64-bit hash, for the stretch of some length that begins there. The names of two
    stretches that lie ``shift`` apart make the name of the stretch that is so much longer, as long as they touch or
    overlap. Lengths double while the texts share a name; then each smaller power of two is added if they still do. So a
    pair takes some 2 log2(n) passes over both texts, each a hash join of their names within the row.
    """
    names = lambda text: F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.xxhash64(c))
    longer = lambda x, shift: F.transform(F.sequence(F.lit(0), F.size(x) - shift - 1), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + shift)))
    tried = lambda x, shift: F.when(F.size(x) > shift, longer(x, shift)).otherwise(F.array().cast("array<bigint>"))
    state = lambda n, shift, up, x, y: F.struct(n.alias("n"), shift.alias("shift"), up.alias("up"), x.alias("x"), y.alias("y"))

    def step(acc: Column, _: Column) -> Column:
        half = F.floor(acc["shift"] / 2).cast("int")

        def judged(t: Column) -> Column:
            longer_ = acc["n"] + acc["shift"]
            yes = state(longer_, F.when(acc["up"], longer_).otherwise(half), acc["up"], t["x"], t["y"])
            return F.when(F.arrays_overlap(t["x"], t["y"]), yes).otherwise(state(acc["n"], half, F.lit(False), acc["x"], acc["y"]))

        more = T.bound(F.struct(tried(acc["x"], acc["shift"]).alias("x"), tried(acc["y"], acc["shift"]).alias("y")), judged)
        return F.when(acc["shift"] == 0, acc).otherwise(more)

    def measured(p: Column) -> Column:
        rounds = F.ceil(F.log2(F.least(F.size(p["x"]), F.size(p["y"])) + 1)).cast("int") * 2 + 1
        start = state(F.lit(1), F.lit(1), F.lit(True), p["x"], p["y"])
        found = F.aggregate(F.sequence(F.lit(1), rounds), start, step, lambda acc: acc["n"])
        return F.when(F.arrays_overlap(p["x"], p["y"]), found).otherwise(F.lit(0))

    return T.bound(F.struct(names(a).alias("x"), names(b).alias("y")), measured)


def echo_hits(drafts: DataFrame, anchors: DataFrame, n: int = DEFAULTS.echo_min_chars) -> DataFrame:
    """(draft_id, anchor_id, echo_max_chars) of the drafts (draft_id, author_id, text) that repeat a run of at least n
    characters of an anchor (author_id, anchor_id, text) of their author.

    Shared n-grams, cut from bounded parts and joined, find the pairs; only those are measured.
    """
    parts = lambda t, text: F.explode(T.pieces(text, n)).alias("part")
    left = drafts.select("draft_id", "author_id", T.clean_text(F.col("text")).alias("t"))
    right = anchors.select("anchor_id", "author_id", echo_source(F.col("text")).alias("a"))
    grams = lambda t, key, text: t.select(*key, parts(t, F.col(text))).select(*key, F.explode(F.array_distinct(T.ngrams(F.col("part"), n))).alias("g")).distinct()
    pairs = grams(left, ["draft_id", "author_id"], "t").join(grams(right, ["anchor_id", "author_id"], "a"), ["author_id", "g"]).select("draft_id", "anchor_id").distinct()
    return pairs.join(left.select("draft_id", "t"), "draft_id").join(right.select("anchor_id", "a"), "anchor_id").select("draft_id", "anchor_id", longest_common(F.col("t"), F.col("a")).alias("echo_max_chars"))


def shared_ngrams(drafts: DataFrame, blocks: DataFrame, n: int = DEFAULTS.copyright_ngram) -> DataFrame:
    """(draft_id, hits, level): distinct n-grams of a draft found in any block; 2 are an issue, 1 is a warning.

    An n-gram holds a whole one of the pieces of half its length that a draft is cut into end to end. So pieces are joined
    with what the blocks hold of that length, by hashes, and n-grams are cut only around those that are found; these are
    joined with the blocks' n-grams as texts, which decides. No draft meets a block it shares nothing with.
    """
    half = (n + 1) // 2
    bare = lambda t, *key: t.select(*key, F.lower(F.coalesce(T.clean_text(F.col("text")), F.lit(""))).alias("t"))
    grams = lambda m: bare(blocks.where(F.length(T.norm(F.col("text"))) >= n)).select(F.explode(T.pieces(F.col("t"), m)).alias("part")).select(F.explode(F.array_distinct(T.ngrams(F.col("part"), m))).alias("g"))
    seeds, block_grams = grams(half).select(F.xxhash64("g").alias("seed")).distinct(), grams(n).distinct()
    beside = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    around = lambda c: F.transform(c, lambda x, i: F.struct(F.xxhash64(x).alias("seed"), F.concat(beside(c, i - 1), x, beside(c, i + 1)).alias("around")))
    cut = T.bound(F.regexp_extract_all(F.col("t"), F.lit(f"(?s).{{1,{half}}}"), F.lit(0)), around)
    found = bare(drafts, "draft_id").where(F.length("t") >= n).select("draft_id", F.inline(cut)).join(seeds, "seed", "left_semi")
    own = found.select("draft_id", F.explode(T.ngrams(F.col("around"), n)).alias("g"))
    hits = own.join(block_grams, "g", "left_semi").distinct().groupBy("draft_id").agg(F.count("*").alias("hits"))
    rows = drafts.select("draft_id").join(hits, "draft_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.withColumn("level", F.when(F.col("hits") >= 2, "issue").when(F.col("hits") == 1, "warn").otherwise("pass"))


def topic_repeats(titles: DataFrame, recent: DataFrame, threshold: float = DEFAULTS.topic_dice) -> DataFrame:
    """(draft_id, recent_place, same, dice): the first recent title, by place, that equals a draft's title or resembles
    it. Both have author_id; an author's recent titles are few and bounded by the caller."""
    left = titles.select("author_id", "draft_id", T.norm(F.col("title")).alias("_a")).where("_a <> ''").withColumn("_ga", T.bigrams(F.col("_a")))
    right = recent.select("author_id", "place", T.norm(F.col("recent_title")).alias("_b")).where("_b <> ''").withColumn("_gb", T.bigrams(F.col("_b")))
    pairs = left.join(right, "author_id")
    scored = pairs.withColumn("same", F.col("_a") == F.col("_b")).withColumn("dice", T.bigram_dice(F.col("_a"), F.col("_b"), F.col("_ga"), F.col("_gb")))
    return scored.where(F.col("same") | (F.col("dice") >= threshold)).groupBy("draft_id").agg(F.min_by(F.struct(F.col("place").alias("recent_place"), "same", "dice"), "place").alias("m")).select("draft_id", "m.*")


def gate_verdicts(drafts: DataFrame, gates: list[tuple[str, DataFrame]]) -> DataFrame:
    """(draft_id, passed, issues, warns): one verdict of each draft over all gates, in the gates' order.

    A gate is a table (draft_id, level, message) with level ``issue`` or ``warn``; drafts without a row passed it.
    """
    found = None
    for place, (name, rows) in enumerate(gates):
        part = rows.where(F.col("level").isin("issue", "warn")).select("draft_id", F.lit(place).alias("at"), "level", F.concat(F.lit(f"{name}:"), F.col("message")).alias("message"))
        found = part if found is None else found.unionByName(part)
    none = F.array().cast("array<string>")
    listed = lambda level: F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct("at", "message")))), lambda x: x["message"])
    joined = drafts.select("draft_id")
    if found is not None:
        joined = joined.join(found.groupBy("draft_id").agg(listed("issue").alias("issues"), listed("warn").alias("warns")), "draft_id", "left")
    else:
        joined = joined.withColumn("issues", none).withColumn("warns", none)
    rows = joined.withColumn("issues", F.coalesce("issues", none)).withColumn("warns", F.coalesce("warns", none))
    return rows.select("draft_id", (F.size("issues") == 0).alias("passed"), "issues", "warns")


def gate_run(drafts: DataFrame, reading: DataFrame, blocks: DataFrame, recent: DataFrame, *, low: int, high: int, words: list[str], min_hits: int, min_citations: int = 1, n: int = DEFAULTS.copyright_ngram, dice: float = DEFAULTS.topic_dice) -> DataFrame:
    """(draft_id, passed, issues, warns): drafts (draft_id, author_id, title, text) through the gates for length, style
    words, citations, reused blocks and repeated topics.

    ``reading`` has (draft_id, item_id, content_text), ``blocks`` text, ``recent`` (author_id, recent_title, place). One
    shared n-gram is a warning, more are an issue. Each gate is a table of its own, made by its operator; drafts that it
    has nothing to say about are not in it. Length and style are stored, so that texts are cleaned once for both.
    """
    texts = stored(drafts.select("draft_id", length_issue(F.col("text"), low, high)["issue"].alias("length"), F.size(style_hits(F.col("text"), words)).alias("style")), "text-gates")
    issue = lambda rows, message: rows.select("draft_id", F.lit("issue").alias("level"), message.alias("message"))
    cited = citation_issues(drafts.select("draft_id", "text"), reading, min_citations).where(F.size("issues") > 0)
    reused = shared_ngrams(drafts.select("draft_id", "text"), blocks, n).where("level <> 'pass'")
    repeated = topic_repeats(drafts.select("author_id", "draft_id", "title"), recent, dice)
    return gate_verdicts(drafts, [
        ("length", issue(texts.where("length IS NOT NULL"), F.col("length"))),
        ("style", issue(texts.where(F.col("style") < min_hits), F.concat(F.col("style").cast("string"), F.lit(f" of {min_hits}")))),
        ("citation", issue(cited, F.array_join("issues", " "))),
        ("copyright", reused.select("draft_id", "level", F.concat(F.col("hits").cast("string"), F.lit(" shared")).alias("message"))),
        ("topic", issue(repeated, F.concat(F.lit("as "), F.col("recent_place").cast("string")))),
    ])


def decision_check(answer: Column) -> Column:
    """The decision of a writer's JSON, write or skip; null if it is neither."""
    said = F.lower(T.strip(F.try_variant_get(F.try_parse_json(T.json_block(answer)), "$.decision", "string")))
    return F.when(said.isin("write", "skip"), said)


def score_message(direction: Column, item_id: Column, title: Column, body: Column, url: Column, published: Column, chars: int = DEFAULTS.score_body_chars) -> Column:
    """The message by which an item is scored: its direction, domain and day, and the item framed as a document."""
    safe = lambda c: T.break_delimiters(F.coalesce(c, F.lit("")))
    some = lambda c, none: F.coalesce(F.nullif(c, F.lit("")), F.lit(none))
    return F.concat(
        F.lit("【方向】"), direction, F.lit("\n【来源域名】"), some(U.netloc(url), "未知"), F.lit("\n【发布日期】"), F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.lit("未知")),
        F.lit('\n<document id="'), item_id.cast("string"), F.lit('">\n【标题】'), safe(title), F.lit("\n【正文】\n"), some(safe(F.substring(T.strip(body), 1, chars)), "（无正文）"), F.lit("\n</document>"),
    )


def cited_quotes(drafts: DataFrame, reading: DataFrame) -> DataFrame:
    """(draft_id, k, item_id, quote, content_text): every note of a draft beside the item of its reading set, if it is one."""
    notes = drafts.select("draft_id", F.explode(T.footnote_defs(F.col("text"))).alias("d")).select("draft_id", "d.k", "d.item_id", "d.quote")
    return notes.join(reading, ["draft_id", "item_id"], "left")


def citation_hints(drafts: DataFrame, reading: DataFrame) -> DataFrame:
    """(draft_id, k, hint): for each note whose quote its item does not hold, the item's sentence that comes closest to it,
    or an empty text. Only such notes reach the Python function; the join has dealt them."""
    held = F.contains(T.norm(F.col("content_text")), T.norm(F.col("quote")))
    lost = cited_quotes(drafts, reading).where(F.col("content_text").isNotNull() & (F.col("quote") != "") & ~held)
    return lost.select("draft_id", "k", closest_sentence("content_text", "quote").alias("hint"))


def citation_issues(drafts: DataFrame, reading: DataFrame, minimum: int = 1) -> DataFrame:
    """(draft_id, issues): marks without definition, definitions without mark, unknown items, empty or wrong quotes.

    ``reading`` has (draft_id, item_id, content_text). A quote must occur in its item, both without blanks and in
    lower case.
    """
    rows = drafts.withColumn("_marks", T.footnote_marks(F.col("text"))).withColumn("_defs", T.footnote_defs(F.col("text")))
    numbers = F.transform("_defs", lambda d: d["k"])
    labelled = lambda values, label: F.transform(F.array_sort(values), lambda k: F.concat(F.lit(label + ":"), k.cast("string")))
    few = F.when(F.size("_defs") < minimum, F.array(F.concat(F.lit("too_few:"), F.size("_defs").cast("string")))).otherwise(F.array().cast("array<string>"))
    own = rows.select("draft_id", F.concat(few, labelled(F.array_except("_marks", numbers), "undefined"), labelled(F.array_except(numbers, F.col("_marks")), "unmarked")).alias("issues"))
    quotes = cited_quotes(drafts, reading)
    wrong = F.when(F.col("content_text").isNull(), "not_in_reading_set").when(F.col("quote") == "", "empty_quote").when(~F.contains(T.norm(F.col("content_text")), T.norm(F.col("quote"))), "quote_not_found")
    bad = quotes.withColumn("w", wrong).where("w IS NOT NULL").groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: F.concat(x["w"], F.lit(":"), x["k"].cast("string"))).alias("more"))
    return own.join(bad, "draft_id", "left").select("draft_id", F.concat("issues", F.coalesce("more", F.array().cast("array<string>"))).alias("issues"))


def longest_run(a: str, b: str) -> tuple[int, int, int]:
    """(i, j, k): the longest run of characters that both texts hold, first in a and then in b; k is 0 if they share none.

    Every place has a number for the stretch of some length that begins there. Two stretches that touch or overlap number
    the longer one they make: lengths double while the texts share one, then each smaller power of two is tried.
    """

    def numbered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
        x, y = numbers[: len(x)], numbers[len(x) :]
        return x, y, np.bincount(y, minlength=int(numbers.max(initial=0)) + 1)[x] > 0

    x, y, shared = numbered(*(np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b)))
    if not shared.any():
        return 0, 0, 0
    k, shift, doubling = 1, 1, True
    while shift:
        if fits := min(len(x), len(y)) > shift:
            many = max(int(x.max()), int(y.max())) + 1
            u, v, both = numbered(*(t[:-shift] * many + t[shift:] for t in (x, y)))
            fits = bool(both.any())
        if fits:
            x, y, shared, k = u, v, both, k + shift
        doubling = doubling and fits
        shift = k if doubling else shift // 2
    i = int(shared.argmax())
    return i, int((y == x[i]).argmax()), k


def grid_runs(a: str, b: str) -> Callable[[int, int, int, int], tuple[int, int, int]]:
    """A function that gives ``longest_run`` of windows a[alo:ahi] and b[blo:bhi] of two short texts, as places in these.

    Equal characters are the bits of a grid, a row for each of a; anding it with itself, moved along the diagonal, leaves
    where longer runs begin.
    """
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    size = len(b) // 8 + 1  # bytes of a row, of which at least one bit stays empty
    wide, none = 8 * size, bytes(size)
    rows = {c: x.to_bytes(size, "little") for c, x in places.items()}
    grid = int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")

    def longest(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        columns = ((1 << bhi) - (1 << blo)).to_bytes(size, "little") * (ahi - alo)
        runs, first, k = (grid >> alo * wide) & int.from_bytes(columns, "little"), 1, 0
        while runs:
            first, k = runs, k + 1
            runs &= runs >> wide + 1
        i, j = divmod((first & -first).bit_length() - 1, wide)
        return i + alo, j, k

    return longest


def matched_chars(a: str, b: str, need: int) -> int:
    """Characters in the matching blocks of ``difflib.SequenceMatcher(None, a, b, autojunk=False)``, so that frequent ones
    count in long texts too; -1 as soon as there are surely fewer than ``need``.

    The longest run, first in a and then in b, cuts a window into two, as difflib does. What the windows that are left can
    hold at most tells when to stop. Runs of short texts are found on a grid; long ones are cut until their windows are short.
    """
    longest = grid_runs(a, b) if len(a) * len(b) <= GRID_CELLS else None
    done, most = 0, min(len(a), len(b))
    left = [(-most, 0, len(a), 0, len(b))]
    while left and done + most >= need:
        room, alo, ahi, blo, bhi = heapq.heappop(left)
        most += room
        if longest:
            i, j, k = longest(alo, ahi, blo, bhi)
        elif (ahi - alo) * (bhi - blo) <= GRID_CELLS:
            if (n := matched_chars(a[alo:ahi], b[blo:bhi], need - done - most)) < 0:
                return -1
            done += n
            continue
        else:
            i, j, k = longest_run(a[alo:ahi], b[blo:bhi])
            i, j = i + alo, j + blo
        if k:
            done += k
            for window in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if (n := min(window[1] - window[0], window[3] - window[2])) > 0:
                    heapq.heappush(left, (-n, *window))
                    most += n
    return done if done + most >= need else -1


def closest(body: str | None, quote: str | None) -> str:
    """The sentence of at least 12 characters that resembles a quote most, the first of equal ones, if by over one half;
    else empty. Both are compared from beginning to end as ``SequenceMatcher.ratio`` does, without blanks and in lower case."""
    fold = lambda x: "".join(x.split()).lower()
    wanted, best, sentence = fold(quote or ""), 0.5, ""
    for s in re.split(r"(?<=[。！？!?.])\s+|\n+", body or ""):
        if len(s.strip()) < 12:
            continue
        folded = fold(s)
        total = len(wanted) + len(folded)
        need = max(int(best * total / 2) - 1, 0)
        while 2.0 * need / total <= best:
            need += 1
        if need <= min(len(wanted), len(folded)) and (n := matched_chars(wanted, folded, need)) >= need:
            best, sentence = 2.0 * n / total, s.strip()
    return sentence


@F.pandas_udf(StringType())
def closest_sentence(body: pd.Series, quote: pd.Series) -> pd.Series:
    """``closest`` of each row."""
    return pd.Series([closest(x, y) for x, y in zip(body, quote, strict=True)])


def article_text(text: Column) -> Column:
    """Body with escaped tags and without definitions, then the definitions in the order of their numbers."""
    body = F.regexp_replace(F.regexp_replace(T.escape_tags(text), T.FOOTNOTE_LINE, ""), r"(?U)\s+$", "")
    lines = F.transform(F.array_sort(T.footnote_defs(text)), lambda d: F.concat(F.lit("[^"), d["k"].cast("string"), F.lit("]: [条目 "), d["item_id"].cast("string"), F.lit("] "), d["quote"]))
    return F.when(F.size(lines) > 0, F.concat(body, F.lit("\n\n"), F.array_join(lines, "\n"))).otherwise(body)


def injected_blocks(blocks: DataFrame, runs: DataFrame, n: int, selection: str = "round_robin", max_chars: int = 500, titles: DataFrame | None = None) -> DataFrame:
    """(author_id, pos, block_id, text, truncated): up to n static blocks (author_id, pos from 0, block_id, text).

    round_robin starts at the author's number of past runs; recency takes the last n in their order; relevant takes
    those that share most distinct bigrams with the titles of the reading set, earlier ones first.
    """
    counted = blocks.join(blocks.groupBy("author_id").agg(F.count("*").alias("_n")), "author_id").join(runs.groupBy("author_id").agg(F.count("*").alias("_runs")), "author_id", "left")
    if selection == "recency":
        rows = counted.where(F.col("pos") >= F.col("_n") - n).withColumn("_at", F.col("pos") - F.greatest(F.col("_n") - n, F.lit(0)))
    elif selection == "relevant":
        joined = titles.groupBy("author_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]), "").alias("_t"))
        shared = F.size(F.array_intersect(F.array_distinct(T.ngrams(T.norm(F.col("text")), 2)), F.array_distinct(T.ngrams(T.norm(F.col("_t")), 2))))
        rows = counted.join(joined, "author_id", "left").withColumn("_at", F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc(F.coalesce(shared, F.lit(0))), "pos")) - 1)
    else:
        rows = counted.withColumn("_at", F.pmod(F.col("pos") - F.coalesce("_runs", F.lit(0)), F.col("_n")))
    return rows.where(F.col("_at") < n).select("author_id", F.col("_at").cast("int").alias("pos"), "block_id", F.substring("text", 1, max_chars).alias("text"), (F.length("text") > max_chars).alias("truncated"))


def repeated_issues(runs: DataFrame) -> DataFrame:
    """Adds ``stop`` to rounds of rewriting (run_id, round, issues): the issues are those of the round before."""
    w = Window.partitionBy("run_id").orderBy("round")
    return runs.withColumn("stop", F.coalesce(F.array_sort("issues") == F.lag(F.array_sort("issues")).over(w), F.lit(False)))


def prune_ratio(before: Column, after: Column) -> Column:
    return F.try_divide((F.length(before) - F.length(after)).cast("double"), F.length(before).cast("double"))


def fill_placeholders(template: Column, values: dict[str, Column]) -> Column:
    """The template with each ``{name}`` that is given replaced; other braces stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def memory_texts(modules: DataFrame, memory: DataFrame, n: int) -> DataFrame:
    """(author_id, module, text) of every configured module: its rendered memory, or the text for an empty one."""
    return modules.select("author_id", "module").join(render_memory(memory, n), ["author_id", "module"], "left").fillna(NO_MEMORY, ["text"])


def render_memory(memory: DataFrame, n: int) -> DataFrame:
    """(author_id, module, text): dated bullets of the n newest entries, newest first."""
    w = Window.partitionBy("author_id", "module").orderBy(F.desc("created_at"), F.desc("entry_id"))
    top = memory.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    line = F.concat(F.lit("- ["), F.date_format("created_at", "yyyy-MM-dd"), F.lit("] "), F.col("content"))
    return top.groupBy("author_id", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def render_reading_set(rows: DataFrame, chars: int = DEFAULTS.reading_body_chars) -> DataFrame:
    """(author_id, text): entries (place, item_id, title, url, published_at, relevance, content_text) in order.

    Each is framed as a document of its id; titles and bodies, cut at ``chars``, can't close or open a frame.
    """
    safe = lambda c: T.break_delimiters(F.coalesce(c, F.lit("")))
    some = lambda c, none: F.coalesce(F.nullif(c, F.lit("")), F.lit(none))
    number = F.col("item_id").cast("string")
    entry = F.concat(
        F.lit('<document id="'), number, F.lit('">\n【条目 '), number, F.lit("】"), safe(F.col("title")), F.lit("\n来源: "), some(F.col("url"), "未知"), F.lit(" | 发布: "),
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("未知")), F.lit(" | 相关分: "), F.col("relevance").cast("string"),
        F.lit("\n正文: "), some(safe(F.substring(T.strip(F.col("content_text")), 1, chars)), "（无正文）"), F.lit("\n</document>"),
    )
    return rows.groupBy("author_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("text"))
