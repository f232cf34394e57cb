"""Text measures, splitters, cleaners and guards as column expressions. Null text gives null, unless stated otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing of a text's content, the mark of a final answer, and the guards' bounds.
STOP = [
    "wait", "maybe", "perhaps", "actually", "think", "okay", "alright", "let's",
    "lets", "guess", "hmm", "hmmm", "well", "just", "mean", "seems", "sure",
    "right", "really", "need", "should", "would", "could", "might", "going",
    "want", "know", "remember", "recall", "check", "verify", "again", "also",
    "first", "then", "next", "that", "this", "with", "from", "have", "what",
]
FINAL_ANSWER = "**Final Answer**"
RATIO = {1: (0.35, 1.30), 2: (0.75, 1.35)}
CONTENT_RECALL = {1: 0.50, 2: 0.70}
REVOICE_RATIO, REVOICE_RECALL, STYLE_RATIO = (0.90, 1.60), 0.70, (0.90, 2.20)
MIN_RATIO_CHARS, MISSING_NUMBERS_SHARE, MIN_CONTENT_WORDS, MAX_NEW_LIST_LINES, MIN_UNIT_CHARS = 300, 0.10, 5, 2, 20
PARAGRAPH_GAP = r"\n[ \t]*+\n\s*+"
LIST_LINE = r"(?m)^\s*+(?:[0-9]+[.)]|[-*•])\s"
PREAMBLE = (
    r"(?i)\A(?:(?:sure|certainly|of course)[,.!]?\s*)?(?:here(?:'s| is| are)|below is|the (?:rewritten|revised|converted|"
    r"transformed) (?:text|version)|rewritten text)[^\n]{0,120}?:[ \t]*\n+"
)
FENCE = r"(?s)\A```[a-zA-Z]*\n(.*?)\n```\z"

_WHITE = " \t\n\r\f\x0b"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """text without ASCII white space at either end."""
    return F.btrim(text, F.lit(_WHITE))


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"[^ \t-\r]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+"))


def token_count(text: Column, count: Callable[[Column], Column] = word_count) -> Column:
    """Tokens by any counter that maps a column of texts to one of numbers, such as a pandas UDF over a tokenizer."""
    return count(text)


def density(text: Column, pattern: str, per: int = 1000) -> Column:
    """Matches of pattern per `per` words, at least one word being assumed."""
    return per * F.regexp_count(text, F.lit(pattern)) / F.greatest(word_count(text), F.lit(1))


def numbers(text: Column) -> Column:
    """Distinct numbers as written, but without a comma that stands before just three digits."""
    groups = F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    return F.array_distinct(F.regexp_extract_all(groups, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def missing_numbers(source: Column, rewrite: Column) -> Column:
    """{missing, total}: numbers of source that rewrite lacks, and all of source."""
    return let(
        numbers(source),
        lambda own: F.struct(F.size(F.array_except(own, numbers(rewrite))).alias("missing"), F.size(own).alias("total")),
    )


def content_words(text: Column, stop: list[str] = STOP) -> Column:
    """Distinct lower-case words of four letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, stop)))


def content_recall(source: Column, rewrite: Column, least: int = MIN_CONTENT_WORDS) -> Column:
    """Share of source's content words that rewrite has; null if there are fewer than `least`."""
    share = lambda own: F.size(F.array_intersect(own, content_words(rewrite))) / F.size(own)
    return let(content_words(source), lambda own: F.when(F.size(own) >= least, share(own)))


def guard(
    source: Column, rewrite: Column, finish: Column, ratio: tuple[float, float], recall: float, list_count: bool = True
) -> Column:
    """Why a rewrite is not acceptable, the first reason that holds; null if it is.

    In order: truncated, empty, too_short or too_long (sources of 300 characters or more), numbers_missing,
    content_lost, list_introduced. Reasons after the second carry their measure behind a colon.
    """
    r = F.length(rewrite) / F.length(source)
    two = lambda x: F.format_string("%.2f", x)
    long_enough = F.length(source) >= MIN_RATIO_CHARS
    lists = lambda x: F.regexp_count(x, F.lit(LIST_LINE))
    more = lists(rewrite) - lists(source)
    facts = F.struct(
        missing_numbers(source, rewrite).alias("numbers"), content_recall(source, rewrite).alias("recall"), more.alias("lists")
    )

    def by_facts(x: Column) -> Column:
        miss, total = x["numbers"]["missing"], x["numbers"]["total"]
        lost = miss > F.greatest(F.lit(1), F.ceil(MISSING_NUMBERS_SHARE * total))
        added = F.concat(F.lit("list_introduced:"), x["lists"]) if list_count else F.lit("list_introduced")
        return (
            F.when(lost, F.format_string("numbers_missing:%d/%d", miss, total))
            .when(x["recall"] < recall, F.concat(F.lit("content_lost:"), two(x["recall"])))
            .when(x["lists"] > MAX_NEW_LIST_LINES, added)
        )

    return (
        F.when(finish == "length", "truncated")
        .when(strip(rewrite) == "", "empty")
        .when(long_enough & (r < ratio[0]), F.concat(F.lit("too_short:"), two(r)))
        .when(long_enough & (r > ratio[1]), F.concat(F.lit("too_long:"), two(r)))
        .otherwise(let(facts, by_facts))
    )


def check(source: Column, rewrite: Column, pass_no: int, finish: Column) -> Column:
    """The guard of a rewriting pass."""
    return guard(source, rewrite, finish, RATIO[pass_no], CONTENT_RECALL[pass_no])


def check_revoice(
    source: Column, rewrite: Column, finish: Column, ratio: tuple[float, float] = REVOICE_RATIO, recall: float = REVOICE_RECALL
) -> Column:
    """The guard of a change of voice; styles differ by their bounds."""
    return guard(source, rewrite, finish, ratio, recall, list_count=False)


def paragraphs(text: Column) -> Column:
    """{parts, gaps}: paragraphs and what stands behind each, the last gap empty; put together they are the text."""
    gaps = F.regexp_extract_all(text, F.lit(PARAGRAPH_GAP), F.lit(0))
    return F.struct(F.split(text, PARAGRAPH_GAP, -1).alias("parts"), F.concat(gaps, F.array(F.lit(""))).alias("gaps"))


def reassembled(rows: Column) -> Column:
    """The text of segments {position, text, gap}, in any order: each stripped and followed by its gap."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(strip(r["text"]), r["gap"])), "")


def clean_pass1(raw: Column) -> Column:
    """{text, flags}: without a code fence, an introducing line and an echoed label, in this order; null is empty."""
    def flagged(x: Column, test: Callable[[Column], Column], cut: Callable[[Column], Column], name: str) -> Column:
        flags = F.concat(x["flags"], F.array(F.lit(name)))
        return F.when(test(x["text"]), F.struct(strip(cut(x["text"])).alias("text"), flags.alias("flags"))).otherwise(x)

    def rule(test: Callable[[Column], Column], cut: Callable[[Column], Column], name: str) -> Callable[[Column], Column]:
        return lambda x: flagged(x, test, cut, name)

    start = F.struct(strip(F.coalesce(raw, F.lit(""))).alias("text"), F.array().cast("array<string>").alias("flags"))
    fenced = let(start, rule(lambda t: t.rlike(FENCE), lambda t: F.regexp_extract(t, FENCE, 1), "fence"))
    bare = let(fenced, rule(lambda t: t.rlike(PREAMBLE), lambda t: F.regexp_replace(t, PREAMBLE, ""), "preamble"))
    return let(bare, rule(lambda t: F.startswith(t, F.lit("Text:")), lambda t: F.substr(t, F.lit(6)), "echoed_label"))


def parse_pass2(raw: Column, truncated: Column) -> Column:
    """{text, subs, flags}: the last complete <REWRITTEN> block; without one all behind the last opening tag, unless
    the response was truncated (then text is null). subs: the <SUB> items outside all blocks, by line and without list
    marks, then those inside the text that are not among them. Tags are taken out of the text."""
    block, sub = r"(?si)<REWRITTEN>(.*?)</REWRITTEN>", r"(?si)<SUB>(.*?)</SUB>"
    tag, opening = r"(?i)</?(?:SUB|REWRITTEN)>", r"(?i)<REWRITTEN>"
    raw = F.coalesce(raw, F.lit(""))
    items = lambda t: F.regexp_extract_all(t, F.lit(sub), F.lit(1))
    lines = F.flatten(F.transform(items(F.regexp_replace(raw, block, "")), lambda b: F.split(strip(b), "\n")))
    outside = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^\s*+(?:[-*•]|[0-9]+[.)])\s*+", "")))

    def made(x: Column) -> Column:
        own = F.filter(outside, lambda s: s != "")
        inside = F.array_distinct(F.filter(F.transform(items(x["t"]), strip), lambda s: s != ""))
        subs = F.concat(own, F.array_except(inside, own))
        flags = F.array_compact(F.array(F.when(x["open"], "unclosed"), F.when(x["t"].rlike(tag), "tags_in_text")))
        return F.struct(strip(F.regexp_replace(x["t"], tag, "")).alias("text"), subs.alias("subs"), flags.alias("flags"))

    blocks = F.regexp_extract_all(raw, F.lit(block), F.lit(1))
    tail = F.element_at(F.split(raw, opening, -1), -1)
    none = F.struct(
        F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("subs"),
        F.array(F.lit("no_rewritten_block")).alias("flags"),
    )
    whole = F.size(blocks) > 0
    taken = F.struct(F.when(whole, F.element_at(blocks, -1)).otherwise(tail).alias("t"), (~whole).alias("open"))
    lost = ~whole & (~raw.rlike(opening) | F.coalesce(truncated, F.lit(False)))
    return F.when(lost, none).otherwise(let(taken, made))


def units(text: Column, level: str = "sentence") -> Column:
    """Sentences or (level step) paragraphs of at least 20 characters, stripped."""
    gap = PARAGRAPH_GAP if level == "step" else r"(?<=[.!?])\s+|\n+"
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), gap, -1), strip), lambda u: F.length(u) >= MIN_UNIT_CHARS)


def verbatim_match(original: Column, rewrite: Column, level: str = "sentence") -> Column:
    """{found, units}: units of the original that the rewrite holds word for word."""
    found = lambda u: F.struct(F.size(F.filter(u, lambda x: F.contains(rewrite, x))).alias("found"), F.size(u).alias("units"))
    return let(units(original, level), found)


def split_answer(text: Column, mark: str = FINAL_ANSWER) -> Column:
    """{reasoning, gap, answer} whose concatenation is the text; split at the last mark, no mark: all is reasoning."""
    n = F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)
    head = F.when(F.contains(text, F.lit(mark)), F.left(text, n)).otherwise(text)
    kept = F.rtrim(head, F.lit(_WHITE))
    return F.struct(
        kept.alias("reasoning"),
        F.substr(head, F.length(kept) + 1).alias("gap"),
        F.substr(text, F.length(head) + 1).alias("answer"),
    )


def normalized(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def last_number(text: Column) -> Column:
    """The last number as text, without commas and trailing points; null if there is none."""
    found = F.regexp_extract_all(F.replace(text, F.lit(",")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.try_element_at(found, F.lit(-1))


def after_last(text: Column, mark: str) -> Column:
    """What follows the last mark, stripped; null if there is none."""
    return F.when(F.contains(text, F.lit(mark)), strip(F.substring_index(text, mark, -1)))


def strip_think(text: Column) -> Column:
    """Without the tags of a scratchpad."""
    return strip(F.replace(F.replace(text, F.lit("</think>")), F.lit("<think>")))


def _wider(h: Column, by: int) -> Column:
    """Hashes of the windows `by` words wider, from those of windows of at least as many words."""
    paired = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + by)))  # those at the end lack a second half
    return F.slice(paired, F.lit(1), F.greatest(F.size(h) - by, F.lit(0)))


def _grams(w: Column, n: int) -> Column:
    """A 64-bit hash of each n-word window of an array of words; none if there are fewer words.

    Hashes of windows are made of those of two shorter ones, which overlap unless n is twice their length.
    """
    if n == 1:
        return F.transform(w, lambda x: F.xxhash64(x))
    half = (n + 1) // 2
    return let(_grams(w, half), lambda h: _wider(h, n - half))


def _share(grams: Column) -> Column:
    """Distinct values to all."""
    return let(grams, lambda g: F.try_divide(F.size(F.array_distinct(g)), F.size(g)))


def _ratio(w: Column, n: int) -> Column:
    """Distinct n-word windows to all of an array of words, told apart by their hashes; 1 below 4n words."""
    return F.when(F.size(w) < 4 * n, 1.0).otherwise(_share(_grams(w, n)))


def repetition_ratio(text: Column, n: int = 4) -> Column:
    """Distinct n-word windows to all of them; 1 if there are fewer than 4n words."""
    return let(words(text), lambda w: _ratio(w, n))


def loop_onset(w: Column, least: float = 0.60, window: int = 400, step: int = 100, n: int = 8) -> Column:
    """Where the first window of an array of words begins that repeats itself: fewer of its n-word windows than `least`
    of all are distinct. Null if there is none. Windows begin every `step` words, the last one before the end.

    The hashes are made once for all windows; a window's own are put into a set. Windows behind the first bad one are not
    looked at.
    """
    return let(_grams(w, n), lambda g: _onset(w, g, least, window, step, n))


def _onset(w: Column, g: Column, least: float, window: int, step: int, n: int) -> Column:
    inside = window - n + 1
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - window - 1, F.lit(0)), F.lit(step)), lambda i: i < F.size(w) - window)
    distinct = lambda i: F.size(F.array_distinct(F.slice(g, i + 1, F.lit(inside))))
    return F.aggregate(starts, F.lit(None).cast("int"), lambda a, i: F.when(a.isNotNull(), a).when(distinct(i) < least * inside, i))


def clean_prefix(text: Column, least: float = 0.60, min_words: int = 400, window: int = 400, step: int = 100) -> Column:
    """The text's words up to the first window that repeats itself (8-word windows), cut at the last sentence end if
    that lies in its second half; null with fewer than min_words left, or if the rest repeats itself (12 words)."""
    return let(words(text), lambda w: _clean(w, loop_onset(w, least, window, step), least, min_words))


def _clean(w: Column, onset: Column, least: float = 0.60, min_words: int = 400) -> Column:
    """clean_prefix of a text's words."""
    kept = lambda at: F.when(at >= min_words, F.array_join(F.slice(w, F.lit(1), at), " "))
    cut = F.when(F.size(w) >= min_words, let(F.coalesce(onset, F.size(w)), kept))

    def ended(t: Column) -> Column:
        b = F.length(t) - F.length(F.substring_index(t, ". ", -1)) - 1
        kept = F.when(F.contains(t, F.lit(". ")) & (b - 1 > F.length(t) * 0.5), F.left(t, b)).otherwise(t)
        return strip(kept)

    return let(let(cut, ended), lambda t: F.when(let(words(t), lambda w: _ratio(w, 12)) >= least, t))


def build_output(mode: Column, reasoning: Column, content: Column) -> Column:
    """A training target: the content alone for the modes style and verbose; else reasoning and content, or reasoning
    alone if it does not repeat itself, or its clean beginning; null if nothing is left."""
    both = F.struct(*[strip_think(F.coalesce(x, F.lit(""))).alias(n) for x, n in ((reasoning, "r"), (content, "c"))])

    def joined(x: Column) -> Column:
        r, c = x["r"], x["c"]
        # the windows of 12 words are made of those of 8, which the search for a loop needs
        alone = let(words(r), lambda w: let(_grams(w, 8), lambda g: F.when(F.size(w) < 48, r).when(_share(_wider(g, 4)) >= 0.60, r).otherwise(_clean(w, _onset(w, g, 0.60, 400, 100, 8)))))
        return F.when(c != "", F.when(r == "", c).otherwise(F.concat(r, F.lit("\n\n"), c))).when(r != "", alone)

    return let(both, lambda x: F.when(mode.isin("style", "verbose"), F.nullif(x["c"], F.lit(""))).otherwise(joined(x)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, in characters: by halving, so that long texts are compared some 20 times."""
    low = F.least(F.length(a), F.length(b))
    begin = F.struct(F.lit(0).alias("low"), (low + 1).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        same = F.left(a, mid) == F.left(b, mid)
        open_ = acc["high"] - acc["low"] > 1
        return F.struct(
            F.when(open_ & same, mid).otherwise(acc["low"]).alias("low"), F.when(open_ & ~same, mid).otherwise(acc["high"]).alias("high")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), begin, step, lambda acc: acc["low"])


def trimmed(text: Column, first: int = 900, last: int = 600) -> Column:
    """Long texts by their first and last characters, and how many are left out between."""
    out = F.concat(F.left(text, F.lit(first)), F.lit(" [... "), F.format_number(F.length(text) - first - last, 0), F.lit(" characters ...] "), F.right(text, F.lit(last)))
    return F.when(F.length(text) > first + last, out).otherwise(text)


def segment_key(i: Column, j: Column, text: Column) -> Column:
    return F.concat_ws(":", i, j, F.left(F.sha1(text.cast("binary")), F.lit(12)))


def sidecar_name(path: Column, suffix: str = ".meta.json") -> Column:
    """The name of the file beside path that describes it."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def is_plain_number(text: Column) -> Column:
    return text.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")


def as_target(text: Column, reasoning: Column) -> Column:
    """A training target; that of a reasoning model opens its scratchpad."""
    return F.when(reasoning, F.concat(F.lit("<think>\n"), text)).otherwise(text)
