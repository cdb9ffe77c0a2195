"""Texts that were cut off, by a vocabulary trie, the shape of the last line, and length evidence.

A first pass sums up the end of every text: marks that a cut leaves, markup left open, a complete
ending, or an open ending with its final token and the shape of its last line.  A second pass collects
the vocabulary of the *inner* tokens of all texts, and how often structural lines
(lists, tables, headings) of every shape occur complete inside texts: shapes are looked up as words are.

Final tokens are then looked up in a trie of the vocabulary.  The trie is distributed:
its upper levels are a table of word beginnings, the tries below them are built shard by shard, and
a beginning of very many words is split at a deeper level, so no task holds more than the words of its shard.  A final
token that is no known word but a proper prefix of known words was cut.  Next comes length: where the open ends of a
source pile up at one length (characters or bytes), they were cut there; a complete end never was.  Marks, open markup,
sentences and line shapes judge only what neither the trie nor a length explains: a text broken off between words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width

#: A shape must occur complete that often inside texts to be an ending.
SHAPE_SUPPORT = 5
#: Cuts of one source at one length that make the length a limit, and their least share of that length's texts.
LIMIT_SUPPORT, LIMIT_SHARE = 3, 0.5
#: Least share of a source's cuts that pile up at a limit; scattered cuts that share a length by chance don't.
LIMIT_PILE = 0.02
#: Words to a shard of the trie: beginnings of more are split at a deeper level.
SHARD_WORDS = 200_000
#: Characters that a worker keeps as lines already seen.
LINE_MEMORY_CHARS = 32_000_000

# Marks left by a cut, and ends of sentences in the scripts at hand.
CUT_MARKS = ("…", "...", "�", "[...]", "[…]", "[truncated]", "(truncated)", "<truncated>", "[cut]")
SENTENCE_ENDS = ".?!。؟！？؛।»”\""
GREEK_ENDS = ";·"  # a question mark and a stop in Greek only
STRUCTURAL = "*|!=#:;{[<-"

_GREEK = re.compile(r"[\u0370-\u03ff\u1f00-\u1fff]\W*$")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_DIGITS = re.compile(r"\d+")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MARKUP = re.compile(r"\[\[[^\[\]]*\]\]|\{\{[^{}]*\}\}|<ref[^<>]*/>|<ref[^<>]*>[^<]*</ref>|<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_OPEN_REF = re.compile(r"<ref(?:\s[^<>/]*)?>")
_HAS_STYLE = re.compile(r"[.?!。؟](?:\s|$)|\[\[|'''|\{\{|<ref|==|。")
_CLOSING_LINK = re.compile(r"\[\[[^\[\]:|]+:[^\[\]]*\]\]$")  # categories, languages, files: they close a page
_STRUCT_END = re.compile(r"(\]\]|\}\}|\|\}|-->|=|>)$")


def line_shape(line: str) -> str:
    """A line with its words as W or w and its numbers as nines (up to five)."""
    line = _DIGITS.sub(lambda m: "9" * min(len(m[0]), 5), line.strip())
    return _LETTERS.sub(lambda m: "W" if m[0][0].isupper() else "w", line)


def left_open(text: str) -> bool:
    """Markup opened more often than closed, or a tag broken off at the end."""
    if text.count("{{") > text.count("}}") or text.count("[[") > text.count("]]") or text.count("<!--") > text.count("-->"):
        return True
    tables = text.count("\n{|") + text.startswith("{|")
    if tables > text.count("\n|}") + text.startswith("|}"):
        return True
    if text.count("<ref") and len(_OPEN_REF.findall(text)) > text.count("</ref>"):
        return True
    last = text.rfind("<")
    return last >= 0 and ">" not in text[last:] and len(text) - last < 200 and text[last + 1 : last + 2].isalpha() and "\n" not in text[last:]


def _complete(line: str) -> bool | None:
    """True if the last line ends as sentences and markup do, None if only its shape can tell, False if it is open."""
    if line[-1] in SENTENCE_ENDS and not (line.startswith("!") and line.endswith("!!")):  # a table's header ends its cells so
        return True
    if line[-1] in GREEK_ENDS and _GREEK.search(line):
        return True
    if _STRUCT_END.search(line):
        if line[0] in STRUCTURAL and not (line[0] == "*" and not line.endswith("]]")):
            return not (line.startswith("=") and not line.endswith("==")) or None
        if not line.endswith("]]") or _CLOSING_LINK.search(line):
            return True
        tail = _MARKUP.sub("", line)  # prose that ends in an inline link: complete if nothing but markup follows the last sentence
        tail = tail.rstrip()
        return True if not tail or tail[-1] in SENTENCE_ENDS or tail[-1] in "=|}" else False
    return None if line[0] in STRUCTURAL else False


def _last_token(line: str) -> str:
    """The word at the very end of a line, or ''."""
    m = None
    for m in _WORD.finditer(line):
        pass
    return m[0] if m and m.end() == len(line) else ""


def ending(text: str | None) -> tuple[str, str, str]:
    """Verdict (whole, cut, prose, bare, shape), final token, shape of the last line.

    A text with a cut's mark or open markup is cut.  Other open ends wait for the vocabulary: of prose, of a text without
    sentences and markup (bare), or of a structural line (shape), which waits for the shapes too.  NULL and blank texts are whole.
    """
    s = text.rstrip() if text else ""
    if not s:
        return "whole", "", ""
    if any(s.endswith(m) for m in CUT_MARKS):
        body = next(s[: -len(m)] for m in sorted(CUT_MARKS, key=len, reverse=True) if s.endswith(m)).rstrip()
        if not body or (body[-1] in SENTENCE_ENDS and not s.endswith("�")):
            return "whole", "", ""
        return "cut", _last_token(body[body.rfind("\n") + 1 :].strip()), ""
    line = s[s.rfind("\n") + 1 :].strip()
    if left_open(s):
        return "cut", _last_token(line), ""
    done = _complete(line)
    if done:
        return "whole", "", ""
    if done is None:
        return "shape", _last_token(line), line_shape(line)
    return ("prose" if _HAS_STYLE.search(s) else "bare"), _last_token(line), ""


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).to_pylist()
        found = [ending(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string()),
                pa.array([len(t) if t else 0 for t in texts], pa.int64()), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
            ],
            ["id", "source", "verdict", "token", "shape", "n_chars", "n_bytes"],
        )


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct inner words of a partition (kind w, n 0) and counts of complete structural lines by shape (kind s)."""
    seen: dict[str, str | None] = {}
    size = 0
    words: set[str] = set()
    shapes: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        kinds = ["w"] * len(words) + ["s"] * len(shapes)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array([*words, *shapes], pa.string()), pa.array([0] * len(words) + list(shapes.values()), pa.int64())], ["kind", "item", "n"]
        )
        words.clear()
        shapes.clear()
        return batch

    for b in batches:
        for text in b.column(0).to_pylist():
            s = text.rstrip() if text else ""
            if not s:
                continue
            lines = s.split("\n")
            for line in set(lines[:-1]):
                if line not in seen:
                    bare = line.strip()
                    seen[line] = line_shape(bare) if bare and bare[0] in STRUCTURAL and bare[-1] not in SENTENCE_ENDS else None
                    size += len(line) + 60
                    words.update(_WORD.findall(line))
                if (shape := seen[line]) is not None:
                    shapes[shape] = shapes.get(shape, 0) + 1
            words.update(_WORD.findall(lines[-1])[:-1])
        if len(words) > 500_000:
            yield out()
        if size > LINE_MEMORY_CHARS:
            seen.clear()
            size = 0
    yield out()


def build_trie(words: list[str]) -> dict:
    """Nested dicts by character; the key '' marks a word's end."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def look_up(trie: dict, token: str) -> tuple[bool, bool]:
    """Whether the token is a word of the trie, and a proper prefix of one."""
    node = trie
    for c in token:
        node = node.get(c)
        if node is None:
            return False, False
    return "" in node, len(node) > ("" in node)


def _shard(tokens: pa.Table, words: pa.Table) -> pa.Table:
    asked = tokens["item"].to_pylist() if tokens.num_rows else []
    begin = {t[:3] for t in asked} | {t for t in asked if len(t) < 3}
    trie = build_trie([w for w in (words["item"].to_pylist() if words.num_rows else []) if w[:3] in begin or w[:2] in begin])
    found = [look_up(trie, t) for t in asked]
    return pa.table({"item": pa.array(asked, pa.string()), "known": pa.array([k for k, _ in found], pa.bool_()), "prefix": pa.array([p for _, p in found], pa.bool_())})


def _upper(items: DataFrame, words: DataFrame, low: int, high: int) -> DataFrame:
    """Items of ``low`` to ``high - 1`` characters against the trie's levels of these depths, kept as a table of beginnings."""
    n = F.length("item")
    levels = words.filter(n >= low).select(F.explode(F.sequence(F.lit(low), F.least(n, F.lit(high - 1)))).alias("k"), "item")
    table = levels.groupBy(F.expr("substring(item, 1, k)").alias("item")).agg(F.max(F.length("item") == F.col("k")).alias("known"), F.max(F.length("item") > F.col("k")).alias("prefix"))
    no = F.lit(False)
    return items.filter((n >= low) & (n < high)).join(table, "item", "left").select("item", F.coalesce("known", no).alias("known"), F.coalesce("prefix", no).alias("prefix"))


def _looked_up(items: DataFrame, words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``item, known, prefix`` of every item against the trie of the words: known as a word, and a proper prefix of words.

    The trie's upper levels are a table; the levels below are built shard by shard, by the first two characters.
    Beginnings of more than ``shard_words`` words are looked at again by twice as many characters.
    """
    spark = items.sparkSession
    out, depth = _upper(items, words, 1, 2), 2
    width = max(4 * max(8, shuffle_width(spark)), -(-words.count() // shard_words))
    while True:
        n = F.length("item")
        items, words, begin = items.filter(n >= depth), words.filter(n >= depth), F.substring("item", 1, depth)
        heavy = cut_lineage(words.groupBy(begin.alias("begin")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_words).select("begin"))
        some = heavy.count()
        asked, held = items.withColumn("begin", begin), words.withColumn("begin", begin)
        light_asked, light_held = (asked.join(heavy, "begin", "left_anti"), held.join(heavy, "begin", "left_anti")) if some else (asked, held)
        shard = F.pmod(F.xxhash64("begin"), F.lit(width)).alias("shard")
        deep = (
            light_asked.select(shard, "item").groupBy("shard").cogroup(light_held.select(shard, "item").groupBy("shard"))
            .applyInArrow(lambda t, w: _shard(t, w), "item string, known boolean, prefix boolean")
        )
        out = out.unionByName(deep)
        if not some:
            return out
        items, words = asked.join(heavy, "begin", "left_semi").select("item"), held.join(heavy, "begin", "left_semi").select("item")
        out = out.unionByName(_upper(items, words, depth, 2 * depth))
        depth *= 2


def truncated(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    """``row_id, source, n_chars, n_bytes, reason`` of every row; reason is NULL for whole texts.

    Reasons, the first that holds: ``token`` (the final token is an unknown proper prefix of known words), ``limit`` (open
    end at a length where the source's cuts pile up), ``end`` (mark or open markup), ``sentence`` (broken off between words),
    ``shape`` (a list, table or heading line of a shape that is the beginning of usual shapes and none itself).  NULL, empty and blank texts are whole, as are texts without
    sentences and markup that end in a known word.  A NULL source is a source of its own.  Whole texts are read,
    whatever their length; other columns are ignored.
    """
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    ends = rows.mapInArrow(_ends, f"id {kind}, source string, verdict string, token string, shape string, n_chars bigint, n_bytes bigint")
    ends = cut_lineage(ends)  # texts are read once per pass; what follows reads the small summaries
    inner = rows.select("text").mapInArrow(_inner, "kind string, item string, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    inner = cut_lineage(inner)

    words = inner.filter("kind = 'w'").select("item")
    tokens = ends.filter("verdict <> 'whole' AND token <> ''").select(F.col("token").alias("item")).distinct()
    broken = _looked_up(tokens, words).filter("prefix AND NOT known").select(F.col("item").alias("token"), F.lit(True).alias("broken"))
    usual = inner.filter(f"kind = 's' AND n >= {SHAPE_SUPPORT}").select("item")
    shapes = ends.filter("verdict = 'shape'").select(F.col("shape").alias("item")).distinct()
    partial = _looked_up(shapes, usual).filter("prefix AND NOT known").select(F.col("item").alias("shape"), F.lit(True).alias("partial"))

    judged = (
        ends.join(broken, "token", "left").join(partial, "shape", "left")
        .withColumn(
            "reason",
            F.when((F.col("verdict") != "whole") & F.col("broken"), "token")
            .when(F.col("verdict") == "cut", "end")
            .when(F.col("verdict") == "prose", "sentence")
            .when((F.col("verdict") == "shape") & F.col("partial"), "shape"),
        )
    )
    judged = cut_lineage(judged)  # one short row per text, read for the piles and for the answer
    total = judged.groupBy("source").agg(F.count("reason").alias("all_cuts"))
    units = F.explode(F.array(F.struct(F.lit("n_chars").alias("unit"), F.col("n_chars").alias("v")), F.struct(F.lit("n_bytes").alias("unit"), F.col("n_bytes").alias("v")))).alias("u")
    piles = judged.select("source", "reason", units).groupBy("source", "u.v", "u.unit").agg(F.count("reason").alias("cuts"), F.count(F.lit(1)).alias("texts"))
    piles = piles.filter((F.col("cuts") >= LIMIT_SUPPORT) & (F.col("cuts") >= LIMIT_SHARE * F.col("texts")))
    # Characters and bytes of plain texts agree: the unit with more cuts at a length is the limit's, the other its shadow.
    best = piles.groupBy("source", "v").agg(F.max(F.struct("cuts", (F.col("unit") == "n_chars").alias("chars"))).alias("b"))
    best = best.alias("p").join(total.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).filter(F.col("p.b.cuts") >= LIMIT_PILE * F.col("t.all_cuts"))
    best = best.select(F.col("p.source").alias("source"), F.col("p.v").alias("v"), F.col("p.b.chars").alias("chars"))
    for n, own in (("n_chars", F.col("chars")), ("n_bytes", ~F.col("chars"))):
        t = best.filter(own).select(F.col("source").alias(f"s_{n}"), F.col("v").alias(f"v_{n}"))
        judged = judged.join(t, F.col("source").eqNullSafe(F.col(f"s_{n}")) & (F.col(n) == F.col(f"v_{n}")), "left")
    at_limit = F.col("v_n_chars").isNotNull() | F.col("v_n_bytes").isNotNull()
    reason = F.when(F.col("reason") == "token", "token").when((F.col("verdict") != "whole") & at_limit, "limit").otherwise(F.col("reason"))
    return judged.select(F.col("id").alias(row_id), "source", "n_chars", "n_bytes", reason.alias("reason"))


def rates(found: DataFrame) -> DataFrame:
    """Per source the rows, the cut rows and their share."""
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count("reason").alias("n_cut"), F.round(F.count("reason") / F.count(F.lit(1)), 6).alias("share_cut")
    )
