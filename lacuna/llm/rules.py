"""Quality rules, lines first: each line is judged, failing lines go, and documents that lose too much of their words are rejected.

A line with words fails for the first of these reasons that holds:

* navigation: it has at least two separators of menus (``|``, ``»``, ``›``, ``•``), or is a short line of menu words only;
* boilerplate: it has one of the phrases in ``BOILERPLATE``;
* symbols: its characters of ``[#*$%&|<>]`` number more than a fifth of its words;
* shouting: more than half of its letters are capitals, and there are at least 20 letters;
* punctuation: it has no sentence end (``.``, ``!``, ``?``, ``…``) anywhere;
* repetition: it equals an earlier line of the document.

Base figures of the whole text come beside it. One pass over the scan's partitions, one document at a time; nothing is shuffled.

Defined cases: null and empty texts have no words and fail the base rule; repeated rows are judged each for itself; a null
``doc_id`` stays null; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, slices, texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Phrases of boilerplate and words of menus, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "licensed under", "lorem ipsum",
    "enable javascript", "click here", "sign up for our newsletter", "subscribe to our newsletter", "skip to content", "powered by",
)
MENU = ("home", "about", "contact", "login", "logout", "register", "search", "menu", "next", "previous", "share", "sitemap", "help", "faq")

BOILER = "|".join(re.escape(p).replace(r"\ ", " ") for p in BOILERPLATE)
BOILER_RE = re.compile(BOILER, re.IGNORECASE | re.ASCII)
NAVIGATION = re.compile("[|»›•]")
MENU_RE = re.compile(rf"(?:(?:{'|'.join(MENU)})[ \t]*){{1,8}}", re.IGNORECASE | re.ASCII)
ENDS = re.compile("[.!?…]")
REASONS = ("navigation", "boilerplate", "symbols", "shouting", "punctuation", "repetition")
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, n_failed_lines long, lost_words long, cleaned string"
)


def judge(line: str) -> str:
    """Why a line with words fails, or the empty string."""
    if len(NAVIGATION.findall(line)) >= 2 or MENU_RE.fullmatch(line.strip(" \t\x0b\x0c\r")):
        return "navigation"
    if BOILER_RE.search(line):
        return "boilerplate"
    data = line.encode()
    n_words = len(data.split())
    if 5 * (len(data) - len(data.translate(None, SYMBOLS))) > n_words:
        return "symbols"
    if len(line) >= 20:
        capitals = sum(map(str.isupper, line))
        if capitals >= 11:  # more than half of 20 letters
            letters = sum(map(str.isalpha, line))
            if letters >= 20 and 2 * capitals > letters:
                return "shouting"
    if not ENDS.search(line):
        return "punctuation"
    return ""


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, n, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def assess(text: str, min_words: int, max_repeat: int, max_lost: int) -> tuple:
    data = text.encode()
    words = data.split()
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    n_lines = n_failed = n_dup = lost = 0
    seen: set[str] = set()
    cleaned = []
    for line in text.split("\n"):
        n = len(line.encode().split())
        if not n:
            cleaned.append(line)
            continue
        n_lines += 1
        again = line in seen
        seen.add(line)
        n_dup += again
        if again or judge(line):
            n_failed += 1
            lost += n
        else:
            cleaned.append(line)
    n_repeat = repeat_words(words)
    failed = len(words) < min_words or 100 * n_repeat > max_repeat * len(words)
    kept = not failed and 100 * lost <= max_lost * len(words)
    return len(words), word_chars, n_symbols, n_dup, n_repeat, failed, kept, n_lines, n_failed, lost, "\n".join(cleaned)


def apply_rules(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, max_lost: int = 30) -> DataFrame:
    """One row per document: base figures, verdicts, the lines and words lost, and the cleaned text.

    ``max_repeat`` and ``max_lost`` are percentages of the words: of repeated windows in the base rule, and of failed lines.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()]
        for batch in slices(batches):
            rows = [assess(t, min_words, max_repeat, max_lost) for t in texts(batch)]
            columns = [batch.column("doc_id").to_pylist(), *zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return narrow(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


#: The same in DuckDB. A line of capitals is found by counting letters that change under lower().
SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
    SELECT doc_id, i, lines[i] AS line, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT doc_id, string_split(t, chr(10)) AS lines, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)
), judged AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
        len(regexp_extract_all(line, '[|»›•]')) >= 2
        OR regexp_full_match(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '(?i)((?:{"|".join(MENU)})[ \t]*){{1,8}}')
        OR regexp_matches(line, '(?i){BOILER}')
        OR 5 * len(regexp_extract_all(line, '[#*$%&|<>]')) > n
        OR (len(regexp_extract_all(line, '\p{{L}}')) >= 20
            AND 2 * len(regexp_extract_all(line, '\p{{Lu}}')) > len(regexp_extract_all(line, '\p{{L}}')))
        OR NOT regexp_matches(line, '[.!?…]') AS bad
    FROM lines WHERE n > 0
), lost AS (
    SELECT doc_id, sum(CASE WHEN again THEN 1 ELSE 0 END)::BIGINT AS n_dup, sum(CASE WHEN again OR bad THEN n ELSE 0 END)::BIGINT AS lost FROM judged GROUP BY doc_id
), win AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS found
    FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), rep AS (
    SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE found > 1) GROUP BY doc_id
), base AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
    FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 30 * n_words AS kept
FROM base
"""
