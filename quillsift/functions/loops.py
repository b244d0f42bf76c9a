"""Detection and removal of repeated blocks in answers.

Detection works inside the row on arrays of lines, so nothing is shuffled. Only the removal of
repeated blocks needs Python, and only rows that hold some unit three times are sent there.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillsift.config import RepairPolicy
from quillsift.functions import answers as an, lexicon as lx, text as tx

S = an.S
EXTENDED = RepairPolicy(version=2)


RUN = "array<struct<start:int,length:int,value:string>>"


def runs(values: Column) -> Column:
    """Maximal runs of equal neighbours of an array of strings: start (from 1), length, value."""

    def found(v: Column) -> Column:
        changes = F.filter(F.sequence(F.lit(1), F.size(v)), lambda i: (i == 1)
                           | ~F.element_at(v, i).eqNullSafe(F.get(v, i - 2)))
        return tx.let(changes, lambda s: F.transform(s, lambda at, k: F.struct(
            at.alias("start"),
            (F.coalesce(F.get(s, k + 1), F.size(v) + 1) - at).alias("length"),
            F.element_at(v, at).alias("value"))))

    return tx.let(values, lambda v: F.when(F.size(v) > 0, found(v)).otherwise(F.array().cast(RUN)))


def plain_lines(text: Column) -> Column:
    """Trimmed non-blank pieces between carriage returns and line feeds."""
    return F.filter(F.transform(_pieces(text), tx.strip), lambda x: F.length(x) > 0)


def _pieces(text: Column) -> Column:
    """Parts between carriage returns and line feeds, empty ones too; one plain character is split at without a pattern."""
    return F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n")


def line_loops(lines: Column, policy: RepairPolicy = RepairPolicy()) -> Column:
    """Runs of one long line repeated often enough to be removed."""
    return F.filter(runs(lines), lambda r: (r["length"] >= policy.min_repeats)
                    & (F.length(r["value"]) >= policy.min_chars)
                    & (tx.word_count(r["value"]) >= policy.min_words))


def item_content(line: Column) -> Column:
    """A list line without its marker, white space squeezed."""
    return tx.squeeze(F.regexp_replace(line, an._wide(lx.ANY_MARKER), ""))


def numbered_keys(text: Column) -> Column:
    """Per line the content of a list item with a number or letter, null for any other line."""
    units = F.filter(_pieces(text), lambda x: F.length(x) > 0)
    return F.transform(units, lambda u: F.when(u.rlike(an._wide(lx.LIST_MARKER)), item_content(u)))


def numbered_loops(keys: Column, policy: RepairPolicy = EXTENDED) -> Column:
    """Runs of list items that differ only in their marker."""
    return F.filter(runs(keys), lambda r: r["value"].isNotNull()
                    & (r["length"] >= policy.numbered_repeats)
                    & (F.length(r["value"]) >= 25) & (tx.word_count(r["value"]) >= 5))


def runaway_list(text: Column, repeats: int = 4, min_chars: int = 60) -> Column:
    """A list whose numbers (or letters) go on while the text of the items stays the same."""
    return _runaway_list(tx.lines(text), repeats, min_chars)


def _runaway_list(lines: Column, repeats: int = 4, min_chars: int = 60) -> Column:
    pattern = f"(?iud)^{S}*(\\d+|[a-zđ])[.)]{S}+(.+)$"
    def item(line: Column) -> Column:
        parts = F.struct(F.lower(F.regexp_extract(line, pattern, 1)).alias("label"),
                         tx.squeeze(tx.fold(F.regexp_extract(line, pattern, 2))).alias("body"))
        number = lambda p: F.when(p["label"].rlike("^\\d"), p["label"].try_cast("decimal(38,0)")).otherwise(
            (F.ascii(p["label"]) - 96).cast("decimal(38,0)"))
        return F.when(line.rlike(pattern), tx.let(parts, lambda p: F.when(
            F.length(p["body"]) >= min_chars, F.struct(number(p).alias("n"), p["body"].alias("body")))))

    # Along a run of equal text the number minus the line index stays constant.
    keys = F.transform(F.transform(lines, item), lambda s, i: F.when(
        s.isNotNull(), F.concat_ws("|", (s["n"] - i).cast("string"), s["body"])))
    return F.exists(runs(keys), lambda r: r["value"].isNotNull() & (r["length"] >= repeats))


def inline_phrase_loop(text: Column) -> Column:
    """Three to 24 words repeated back to back inside a line, at least 24 words and four times."""
    return _inline_phrase_loop(tx.lines(text))


def _inline_phrase_loop(lines: Column) -> Column:
    """Phrase loops of lines.

    For a block width the line becomes a string with one mark per word: ``a`` or ``n`` when the word
    (with or without a letter) equals the one a block later, ``-`` otherwise. A loop is a long enough
    stretch of marks that holds an ``a``.

    Such a stretch has 18 marks or more, so from one of every ``step`` places on, ``near`` marks lie whole in it.
    Lines are marked only where the words at such a place come again 3 to 24 words later, for the widths that fit.
    """
    near, step = 6, 13

    def at_places(words: Column, test) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(words), F.lit(step)), test)

    def comes_again(words: Column) -> Column:
        spaced = lambda at, size: F.concat(F.lit(" "), F.array_join(F.slice(words, at, F.lit(size)), " "), F.lit(" "))
        return at_places(words, lambda at: F.contains(spaced(at + 3, 24 - 3 + near), spaced(at, near)))

    def fits(words: Column, width: Column) -> Column:
        return at_places(words, lambda at: F.slice(words, at, F.lit(near)) == F.slice(words, at + width, F.lit(near)))

    def looped(words: Column, width: Column) -> Column:
        needed = F.greatest(F.lit(4), F.ceil(F.lit(24) / width).cast("int"))
        marks = F.transform(F.sequence(F.lit(1), F.size(words) - width), lambda i: F.when(
            F.element_at(words, i) != F.element_at(words, i + width), F.lit("-")).when(
            F.element_at(words, i).rlike("\\p{L}"), F.lit("a")).otherwise(F.lit("n")))
        stretch = F.concat(F.lit("(?=n*a)[an]{"), (width * (needed - 1)).cast("string"), F.lit("}"))
        return (F.size(words) >= width * needed) & fits(words, width) & F.rlike(F.array_join(marks, ""), stretch)

    def line_loops_inside(words: Column) -> Column:
        # Even the shortest loop repeats 18 words.
        return (an.spare(words) >= 18) & comes_again(words) & F.exists(
            F.sequence(F.lit(3), F.lit(24)), lambda width: looped(words, width))

    return F.exists(lines, lambda x: tx.let(tx.tokens(x), line_loops_inside))


def long_numeric_run(text: Column, length: int = 20) -> Column:
    """At least 20 integers counting up by one with only blanks, commas or semicolons between."""
    number = "(?<![\\w./-])\\d{1,6}(?![\\w./-])"
    chains = F.regexp_extract_all(
        text, F.lit(f"(?U){number}(?:[{lx.WS},;]++{number})*+"), F.lit(0))
    # Along a run of consecutive integers the value minus the position stays constant.
    steps = lambda c: F.transform(F.regexp_extract_all(c, F.lit("\\d+"), F.lit(0)),
                                  lambda n, i: (n.cast("int") - i).cast("string"))
    # Texts without so many numbers in a row are not searched for whole chains.
    enough = text.rlike(f"(?U)(?:\\d{{1,6}}+[{lx.WS},;]++){{{length - 1}}}\\d")
    return F.when(~enough, F.lit(False)).otherwise(
        F.exists(chains, lambda c: F.exists(runs(steps(c)), lambda r: r["length"] >= length)))


def heading_only(text: Column, max_words: int = 16) -> Column:
    """True when an answer consists of titles, markers and lead-ins without any statement."""
    return tx.let(tx.lines(text), lambda found: _heading_only(found, max_words))


def _heading_only(lines: Column, max_words: int = 16) -> Column:
    bare = lambda x: tx.strip(F.btrim(x, F.lit("#>*_` ")))
    marker = "(?iu)^(?:\\d+(?:\\.\\d+)*|[a-zđ]|[ivxlcdm]+)[.)]$"
    opening = "(?iuU)^(?:căn cứ|theo)\\b"
    announcing = f"(?iu)(?:như sau|sau đây){S}*[:.]?$"
    section = f"(?iu)^(?:điều|khoản|chương|mục|phần){S}+(?:\\d+|[ivxlcdm]+)[.:]?{S}*"
    item = f"(?iu)^(?:\\d+|[a-zđ])[.)]{S}+[^{lx.WS}]"
    verb = "(?iuU)\\b(?:là|phải|được|không|có|gồm|cần|chịu)\\b"
    title = ("(?iuU)^(?:thời hiệu|thời hạn|điều kiện|hồ sơ|thủ tục|mức phạt|trách nhiệm|"
             "quyền hạn|căn cứ pháp lý|nội dung|hình thức thi|kiểm định|nguyên tắc)\\b")

    def classify(x):
        in_section = x.rlike(section)
        rest = F.when(in_section, tx.strip(F.regexp_replace(x, section, ""))).otherwise(x)
        return (F.when(x.rlike(marker) | (x.rlike(opening) & x.rlike(announcing)), "scaffold")
                .when(~in_section & x.rlike(item), "statement")
                .otherwise(tx.let(F.struct(in_section.alias("section"), rest.alias("rest")), judge)))

    # More words than allowed, found without counting those of a long line.
    many = f"^(?:[^{lx.WS}]++{S}++){{{max_words}}}[^{lx.WS}]"

    def judge(s):
        rest = s["rest"]
        statement = rest.rlike("[.;!?]") | rest.rlike(many) | rest.rlike(verb)
        good = ~rest.rlike("(?U)\\d") & (s["section"] | F.endswith(rest, F.lit(":")) | rest.rlike(title))
        return (F.when((F.length(rest) == 0) & s["section"], "scaffold").when(F.length(rest) == 0, "nothing")
                .when(statement, "statement").when(good, "title").otherwise("other"))

    def decide(kinds):
        has = lambda kind: F.array_contains(kinds, kind)
        headings = has("title") | has("other")
        return (F.size(kinds) > 0) & F.when(headings, ~has("other")).otherwise(has("scaffold"))

    # The first statement settles it; only texts without any have all their lines classified.
    kind = lambda x: tx.let(bare(tx.strip(x)), classify)
    kinds = F.transform(F.filter(lines, lambda x: F.length(tx.strip(x)) > 0), kind)
    return F.when(F.exists(lines, lambda x: kind(x) == "statement"), F.lit(False)).otherwise(tx.let(kinds, decide))


# --- block removal -----------------------------------------------------------------------------

CHANGE = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("repeats", T.IntegerType()), T.StructField("unit", T.StringType()),
    T.StructField("block_units", T.IntegerType())])
RESULT = T.StructType([T.StructField("text", T.StringType()),
                       T.StructField("changes", T.ArrayType(CHANGE))])


def _spans(text: str, pattern: str):
    found = [(m.start(), m.end(), m.group().strip()) for m in re.finditer(pattern, text)]
    return [s for s in found if s[2]]


def _repeat_counts(codes: np.ndarray, width: int) -> np.ndarray:
    """For every position how many copies of the block of ``width`` units follow each other there."""
    n = len(codes)
    run = np.zeros(n + 1, dtype=np.int64)
    if n > width:
        same = codes[:-width] == codes[width:]
        # Length of the stretch of equal units beginning at each place, by the next unequal place.
        stops = np.where(same, n, np.arange(len(same)))
        nearest = np.minimum.accumulate(stops[::-1])[::-1]
        run[:len(same)] = np.minimum(nearest, len(same)) - np.arange(len(same))
    return run // width + 1


def _loops(spans, policy: RepairPolicy):
    """Non-overlapping repeated blocks from left to right, the narrowest width first."""
    texts = [s[2] for s in spans]
    codes = pd.factorize(np.array(texts, dtype=object))[0] if texts else np.array([], dtype=int)
    chars = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    counts = np.concatenate([[0], np.cumsum([len(t.split()) for t in texts])])
    best = np.zeros(len(texts), dtype=np.int64)
    copies = np.zeros(len(texts), dtype=np.int64)
    for width in range(policy.max_block, 0, -1):
        at = np.arange(max(len(texts) - width + 1, 0))
        size = chars[at + width] - chars[at] + width - 1
        enough = (size >= policy.min_chars) & (counts[at + width] - counts[at] >= policy.min_words)
        repeats = _repeat_counts(codes, width)[at]
        hit = at[enough & (repeats >= policy.min_repeats)]
        best[hit], copies[hit] = width, repeats[hit]
    place = 0
    while place < len(texts):
        if best[place]:
            yield place, int(best[place]), int(copies[place])
            place += int(best[place] * copies[place])
        else:
            place += 1


def _numbered(text: str, policy: RepairPolicy):
    """Runs of list items with equal content, as (first span, last span, copies)."""
    spans = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\r\n]+", text)]
    keys = [" ".join(re.sub(lx.ANY_MARKER, "", s[2]).split()) if re.match(lx.LIST_MARKER, s[2]) else None
            for s in spans]
    begin = 0
    for i in range(1, len(keys) + 1):
        if i < len(keys) and keys[i] is not None and keys[i] == keys[begin]:
            continue
        key = keys[begin]
        if (key is not None and i - begin >= policy.numbered_repeats
                and len(key) >= 25 and len(key.split()) >= 5):
            yield spans[begin], spans[i - 1], i - begin
        begin = i


def _without(text: str, cuts) -> str:
    parts, at = [], 0
    for start, end, *_ in cuts:
        parts.append(text[at:start])
        at = end
    return "".join(parts) + text[at:]


def remove_loops(text: str, policy: RepairPolicy):
    """Text without the later copies of repeated blocks, and what was cut."""
    changes = []
    for unit, pattern in (("line", r"[^\r\n]+"), ("sentence", lx.PY_SENTENCE)):
        spans = _spans(text, pattern)
        cuts = [(spans[p + w - 1][1], spans[p + w * k - 1][1], k, unit, w) for p, w, k in _loops(spans, policy)]
        text = _without(text, cuts)
        changes += cuts
    if policy.version == 2:
        cuts = [(a[1], b[1], k, "numbered_loop", 1) for a, b, k in _numbered(text, policy)]
        text = _without(text, cuts)
        changes += cuts
    return text, changes


def may_loop(text: Column, policy: RepairPolicy) -> Column:
    """Necessary condition for a repeated block: lines, sentences or list items that come again.

    Lambdas are not nested here: the condition ends up in the argument of a Python function, and
    Spark does not extract one whose argument refers to the variable of an outer lambda.
    """
    # Without its final mark a repeated sentence still repeats; a lookbehind would be tried at every character.
    sentences = F.transform(F.split(text, f"[.!?](?={S}|\\z)"), tx.strip)
    again = lambda items: tx.let(items, an.spare)
    out = (again(plain_lines(text)) >= 2) | (again(sentences) >= 2)
    if policy.version == 2:
        out = out | (again(F.filter(numbered_keys(text), lambda k: k.isNotNull())) >= policy.numbered_repeats - 1)
    return out


def with_loops_removed(df: DataFrame, column: str, policy: RepairPolicy = RepairPolicy(),
                       name: str = "proposed", changes: str = "changes") -> DataFrame:
    """Add the text of ``column`` without repeated blocks and the list of cuts."""

    @F.pandas_udf(RESULT)
    def cut(values: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if v is None else remove_loops(v, policy) for v in values]
        return pd.DataFrame({"text": [r[0] for r in rows],
                             "changes": [None if r[1] is None else
                                         [dict(zip(CHANGE.names, c)) for c in r[1]] for r in rows]})

    # Rows that cannot loop send a null. Non-deterministic to the optimizer, so that a later filter
    # on the outcome does not run the function a second time.
    suspects = df.withColumn("_suspect", F.when(may_loop(F.col(column), policy), F.col(column)))
    done = suspects.withColumn("_cut", cut.asNondeterministic()("_suspect"))
    none = F.array().cast(T.ArrayType(CHANGE))
    return (done.withColumn(name, F.coalesce("_cut.text", column))
            .withColumn(changes, F.coalesce("_cut.changes", none)).drop("_suspect", "_cut"))


def _named(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def _cut_reasons(changes: Column) -> Column:
    return _named(F.when(F.exists(changes, lambda c: c["unit"] != "numbered_loop"), F.lit("exact_adjacent_loop")),
                  F.when(F.exists(changes, lambda c: c["unit"] == "numbered_loop"), F.lit("numbered_loop")))


def _list_reasons(lines: Column) -> list[Column]:
    return [F.when(an.repeated_share(lines) >= 0.25, F.lit("repeated_long_lines")),
            F.when(_runaway_list(lines), F.lit("runaway_incrementing_list"))]


def loop_reasons(text: Column, changes: Column) -> Column:
    """Sorted names of the loop kinds; ``changes`` comes from the extended policy on the same text."""
    return F.concat(_cut_reasons(changes), tx.let(tx.lines(text), lambda found: _named(*_list_reasons(found))))


def measurement_reasons(text: Column, changes: Column) -> Column:
    """Loop reasons plus phrase loops, counting runs and answers made of headings only; the lines are cut once."""
    of_lines = tx.let(tx.lines(text), lambda found: _named(
        *_list_reasons(found), F.when(_heading_only(found), F.lit("heading_only")),
        F.when(_inline_phrase_loop(found), F.lit("inline_phrase_loop"))))
    numeric = _named(F.when(long_numeric_run(text), F.lit("long_numeric_run")))
    return F.array_sort(F.array_distinct(F.concat(_cut_reasons(changes), of_lines, numeric)))
