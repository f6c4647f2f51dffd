"""Noise in text from scanned pages: divided words, misread characters, running headers, page numbers.

Method. A corpus frequency lexicon is counted first, divided words apart. A symmetric-delete index
over it proposes corrections: both the unknown token and the lexicon words give keys with one or two
confusable groups of characters deleted (digits and marks inside a word are first replaced by the
letters they stand for; course codes meet under the key with all confusable characters folded, and
so do tokens with many ambiguous marks). A weighted edit distance that knows only confusion pairs
keeps what they explain, frequency ranks it, and where repairs are close, the bigrams with the
neighbouring words decide.
Lines that recur over a document's chunks, with page numbers and misread characters folded away,
are running headers; lines that are nothing but a number in page style are page numbers.

Scale. Two narrow passes over the whole texts, in which Python counts and looks up tokens at C
speed; only counts, rare tokens and candidate lines are shuffled, never texts. What is broadcast
is the top ``TRUSTED`` words by frequency. It saves rows only: words beyond it, their bigrams and
compounds are looked up by joins, so the results are the same for any ``TRUSTED``. Repeated rows
are counted once.

Defined results. Null and blank texts have no cases; a number after a label line is a value, not a
page number; a word divided at its own hyphen keeps it if the corpus writes it so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ricepaper.session import materialize

#: Words known to every task, most frequent first; changes no result.
TRUSTED = 100_000
#: A token with more marks that stand for several letters is looked up with these letters folded.
AMBIGUOUS = 4
#: A correction must be so many times as frequent as the token it replaces.
TIMES = 3
#: Entries of a task's counters before they are handed on.
FLUSH = 400_000

# What is read, what was printed, and what reading it so costs.
CONFUSIONS = [
    ("€", "e", 0.2), ("!", "i", 0.2), ("+", "t", 0.2), ("@", "a", 0.2), ("|", "l", 0.2), ("(", "c", 0.2), ("1", "i", 0.3), ("1", "l", 0.3), ("5", "s", 0.2),
    ("0", "o", 0.2), ("9", "g", 0.2), ("6", "b", 0.2), ("8", "b", 0.3), ("ð", "đ", 0.2), ("$", "s", 0.3), ("£", "e", 0.4), ("!", "l", 0.4), ("|", "i", 0.4),
    ("c", "e", 0.4), ("v", "y", 0.5), ("l", "i", 0.8), ("ri", "n", 0.4), ("ii", "u", 0.3), ("cl", "d", 0.4), ("rn", "m", 0.4), ("li", "h", 0.4), ("vv", "w", 0.3),
    ("h", "li", 0.6), ("d", "cl", 0.6), ("m", "rn", 0.6),
]
# Letters and digits that are taken for each other in codes.
CODE_CLASSES = {"o": "0", "q": "0", "d": "0", "i": "1", "l": "1", "|": "1", "!": "1", "s": "5", "$": "5", "b": "8", "6": "8", "z": "2", "g": "9", "+": "t", "(": "c", "€": "e", "@": "a"}

HYPHENS = "-‐‑­¬"
_EDGE = ".,;:?\"“”‘’'…()[]{}«»!"
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_CODE = re.compile(r"[a-z]{2,4}\d{3,4}[a-z]{2,4}")
_CODE_LIKE = re.compile(r"[a-z0-9|!$+(€@]{7,10}")
_SYMBOLS = frozenset("€!+@|(15096ð8$£")
_MARKS: dict[str, list[str]] = {}
for _seen, _true, _ in CONFUSIONS:
    if len(_seen) == 1 and _seen in _SYMBOLS:
        _MARKS.setdefault(_seen, []).append(_true)
_LETTERS = [(o, t) for o, t, _ in CONFUSIONS if o not in _MARKS]
_SEVERAL = frozenset(c for c, ways in _MARKS.items() if len(ways) > 1)
_SEEN_GROUPS, _TRUE_GROUPS = sorted({o for o, _ in _LETTERS}), sorted({t for _, t in _LETTERS})
_FOLDED_SEEN, _FOLDED_TRUE = (sorted({g.replace("i", "1").replace("l", "1") for g in groups}) for groups in (_SEEN_GROUPS, _TRUE_GROUPS))
_DIVIDED = re.compile(rf"([^\s]*[^\W_]['’]?)[{HYPHENS}]{{1,2}}[ \t\xa0]*$")
_N = r"[\dlIOoSBZ|!]{1,5}"
_BARE = re.compile(rf"(?=[^\n]*\d)[\dlIOoSBZ|!]{{1,4}}|[l|I]{{1,3}}|[ivxlc]{{1,8}}|[IVXLC]{{1,8}}")
_STYLED = re.compile(rf"[-–—~\[(<*•·|=\s]+{_N}[-–—~\])>*•·|=\s]+|[^\W\d_]{{1,6}}\.?\s*{_N}(?:\s*(?:/|[^\W\d_]{{1,3}})\s*{_N})?|{_N}\s*/\s*{_N}|[-–—~\[(]\s*[ivxlc]{{1,8}}\s*[-–—~\])]")
_BULLET = re.compile(r"[-*•·–+]\s|\d+[.)]\s|[a-z][.)]\s")
_AFFIX = re.compile(rf"^{_N}\s*[|¦·•–-]\s+|\s+[|¦·•–-]\s*{_N}$|\s{{3,}}{_N}$|^{_N}\s{{3,}}")
_FOLD = str.maketrans({"1": "i", "l": "i", "!": "i", "|": "i", "0": "o", "5": "s", "$": "s", "+": "t", "(": "c", "€": "c", "e": "c", "@": "a", "9": "g", "8": "b", "6": "b", "ð": "đ", "y": "v", "z": "2"})


_PAIRS = [("rn", "m"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("cl", "d"), ("li", "h")]


def fold(text: str) -> str:
    """A form in which confusable characters, case and blanks no longer differ."""
    text = text.lower()
    for seen, true in _PAIRS:
        text = text.replace(seen, true)
    return " ".join(text.translate(_FOLD).split())


_STARTS = frozenset("0123456789|!(€lo")
_HEAD_STARTS = _STARTS | frozenset(c for c in map(chr, range(0x2000)) if c.isupper())
#: First characters of lines that may be headers, blanks included.
_LINE_STARTS = _HEAD_STARTS | frozenset(" \t\xa0")
_ENDS_DIVIDED = re.compile(rf"[{HYPHENS}][ \t\xa0]*\n")
_CORE_STARTS = frozenset("0123456789|!(€")
_BULLETS, _NUMBERS = frozenset("-*•·–+"), frozenset("lIOoSBZ|!") | frozenset(c for c in map(chr, range(0x10000)) if c.isdecimal())
_NO_END = frozenset(".,;:!?" + HYPHENS)
_TWO_LETTERS = re.compile(r"[^\W\d_]{2}")
_PAGE_WORDS = frozenset(fold(w) for w in ("trang", "page", "p.", "p", "tr.", "tr", "pg.", "pg", "pp."))


def is_page_number(line: str, previous: str) -> bool:
    """Whether a line is only a page number; ``previous`` is the last line before it with content."""
    s = line.strip()
    if not s or len(s) > 24:
        return False
    if _BARE.fullmatch(s):
        return not previous.rstrip().endswith(":")
    if not _STYLED.fullmatch(s):
        return False
    if s[0].isalpha() and (m := re.match(rf"([^\W\d_]+\.?)\s*({_N})", s)):
        word = m[1]
        # a misread digit may look like the end of the word
        return any(fold(word[:k]) in _PAGE_WORDS for k in range(len(word), 0, -1)) and any(c.isdigit() or c in "lIOo" for c in s[len(word) - 1 :])
    return any(c.isdigit() for c in s) or bool(re.search(r"[lIO|]{1,3}|[ivxlc]+", s))


def header_key(line: str) -> tuple[str, bool] | None:
    """``(key, has a page number)`` of a line that may be a running header, else None."""
    s = line.strip()
    # most lines of a paragraph start in lower case, end with a mark or hold the end of a sentence
    if not 4 <= len(s) <= 90 or s[0] not in _HEAD_STARTS or s[-1] in _NO_END or ". " in s:
        return None
    if (s[0] in _BULLETS or s[0].isdigit() or s[1] in ".)") and _BULLET.match(s):
        return None
    # a page number stands at an end
    core = _AFFIX.sub("", s).strip() if s[0] in _NUMBERS or s[-1] in _NUMBERS else s
    if len(core) < 4 or not (core[0].isupper() or core[0] in _CORE_STARTS) or not (core[1:3].isalpha() or _TWO_LETTERS.search(core)):
        return None
    return fold(core), core != s


def norm(raw: str) -> str:
    return raw.strip(_EDGE).lower()


def divided_words(lines: list[str]) -> list[tuple[int, int, str, str]]:
    """``(line, line of the second part, first part, second part)``, lines from 0.

    The second part is the first word of the next line that starts in lower case, page numbers and
    other lines between being skipped, or else of the very next line.
    """
    out = []
    for k, line in enumerate(lines[:-1]):
        if not line or (tail := line.rstrip())[-1:] not in HYPHENS or not tail:
            continue
        m = _DIVIDED.search(line)
        if not m:
            continue
        seen, choice, first = 0, None, None
        for j in range(k + 1, min(len(lines), k + 9)):
            s = lines[j].strip()
            if not s:
                continue
            seen += 1
            if seen > 4:
                break
            if is_page_number(s, lines[k]):
                continue
            if first is None and s[0].isalnum():
                first = j
            if s[0].islower() or (s[0] in "€!+@|(15096ð8" and len(s) > 2 and not header_key(s)):
                choice = j
                break
        choice = choice if choice is not None else first
        if choice is not None:
            second = lines[choice].split()[0]
            if second[0].isalnum() or second[0] in _SYMBOLS:
                out.append((k, choice, m[1].strip("\"“‘(["), second))
    return out


def cost(seen: str, true: str) -> float | None:
    """Weighted edit distance in confusion pairs; None if they don't explain the difference."""
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    n, m = len(seen), len(true)
    if abs(n - m) > 3:
        return None
    for i in range(n + 1):
        for j in range(max(0, i - 3), min(m, i + 3) + 1):
            now = best.get((i, j))
            if now is None:
                continue
            if i < n and j < m and seen[i] == true[j]:
                if now < best.get((i + 1, j + 1), 9.0):
                    best[i + 1, j + 1] = now
            for o, t, c in CONFUSIONS:
                if seen.startswith(o, i) and true.startswith(t, j) and now + c < best.get((i + len(o), j + len(t)), 9.0):
                    best[i + len(o), j + len(t)] = now + c
    return best.get((n, m))


def _variants(token: str) -> list[str]:
    """The token with marks and digits replaced by the letters they stand for, in every way."""
    out = [""]
    for ch in token:
        ways = _MARKS.get(ch, [ch])
        out = [p + w for p in out for w in ways]
    return out


def code_key(token: str) -> str:
    return "#" + "".join(CODE_CLASSES.get(c, c) for c in token)


def _folded(word: str) -> str:
    """The word with the letters that one mark may stand for made equal, and other marks replaced."""
    return "~" + "".join("1" if c in "il" or c in _SEVERAL else _MARKS.get(c, [c])[0] for c in word)


def _deletes(word: str, groups: list[str], keys: set[str]) -> None:
    """Add ``word`` with one or two of ``groups`` deleted, each marked by a tab."""
    # groups of several characters start in few places, so look for the first character
    found = [(at, at + len(g)) for g in groups if g in word for at in range(word.find(g), len(word)) if word.startswith(g, at)]
    found.sort()
    for k, (a, b) in enumerate(found):
        head = word[:a] + "\t"
        keys.add(head + word[b:])
        for c, d in found[k + 1 :]:
            if c >= b:
                keys.add(f"{head}{word[b:c]}\t{word[d:]}")


def unknown_keys(token: str) -> set[str]:
    """Index keys of a token that may be misread."""
    keys: set[str] = set()
    if _CODE_LIKE.fullmatch(token) and any(c.isdigit() for c in token):
        keys.add(code_key(token))
    if sum(c.isalpha() for c in token) * 2 >= len(token):
        if sum(c in _SEVERAL for c in token) > AMBIGUOUS:
            folded = _folded(token)
            keys.add(folded)
            _deletes(folded, _FOLDED_SEEN, keys)
            return keys
        for v in _variants(token):
            if v != token:
                keys.add(v)
            _deletes(v, _SEEN_GROUPS, keys)
    return keys


def lexicon_keys(word: str) -> set[str]:
    """Index keys of a lexicon word."""
    if _CODE.fullmatch(word):
        return {code_key(word)}
    if not _WORD.fullmatch(word):
        return set()
    keys = {word}
    _deletes(word, _TRUE_GROUPS, keys)
    # fewer of these letters can't come from so many ambiguous marks
    if word.count("i") + word.count("l") > AMBIGUOUS:
        folded = _folded(word)
        keys.add(folded)
        _deletes(folded, _FOLDED_TRUE, keys)
    return keys


def _code_cost(seen: str, true: str) -> float | None:
    if len(seen) != len(true) or code_key(seen) != code_key(true):
        return None
    # a digit is rarely taken for another digit
    return sum(1.0 if a.isdigit() and b.isdigit() else 0.3 for a, b in zip(seen, true) if a != b)


def repair_cost(seen: str, true: str) -> float | None:
    return _code_cost(seen, true) if _CODE.fullmatch(true) else cost(seen, true)


def _texts(chunks: DataFrame) -> DataFrame:
    """Distinct ``(id, doc, text)`` with content; only rows whose id repeats are compared whole."""
    rows = chunks.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", F.col("metadata.doc_id").alias("doc"), "text")
    again = rows.groupBy("id").agg(F.count("*").alias("many")).where("many > 1").select("id")
    again = materialize(again, "again")
    once = rows.join(again, "id", "left_anti")
    return once.unionByName(rows.join(again, "id", "left_semi").dropDuplicates(["id", "text"]))


_COUNTED = "kind string, doc string, key string, n long, more long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: token counts ('w'), divided words ('d'), header candidates ('h') and chunks of documents ('c')."""
    raw: Counter = Counter()
    divided: Counter = Counter()
    heads: dict[tuple[str, str], list[int]] = {}
    docs: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words: Counter = Counter()
        for w, n in raw.items():
            if n <= 0:
                continue
            token, low = norm(w), w.lower()
            # marks at a word's edge may be letters, so such a token proves no word
            if (low[0] == "(" and ")" not in low) or low[0] == "!":
                divided[low[0] + low.strip(_EDGE)] += n
                continue
            if token:
                words[token] += n
            if low.rstrip(".,;:")[-1:] == "!":
                divided[token + "!"] += n
        rows = [("w", None, k, n, 0) for k, n in words.items()] + [("d", None, k, n, 0) for k, n in divided.items()]
        rows += [("h", d, k, v[0], v[1]) for (d, k), v in heads.items()] + [("c", d, None, n, 0) for d, n in docs.items()]
        for c in (raw, divided, heads, docs):
            c.clear()
        cols = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["kind", "doc", "key", "n", "more"])

    for batch in batches:
        for doc, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw.update(text.split())
            docs[doc or ""] += 1
            if "\n" not in text:
                continue
            lines = text.split("\n")
            if _ENDS_DIVIDED.search(text):
                for k, j, a, b in divided_words(lines):
                    raw[lines[k].split()[-1]] -= 1
                    raw[b] -= 1
                    if token := norm(a + b):
                        divided[token] += 1
            own: dict[str, bool] = {}
            for line in lines:
                if line[:1] in _LINE_STARTS and (found := header_key(line)) is not None:
                    own[found[0]] = own.get(found[0], False) or found[1]
            for key, affix in own.items():
                at = heads.setdefault((doc or "", key), [0, 0])
                at[0] += 1
                at[1] += affix
        if len(raw) + len(heads) + len(divided) > FLUSH:
            yield flush()
    yield flush()


def lexicon(counts: DataFrame) -> DataFrame:
    """``(token, n)``: how often each token stands whole in the corpus; 0 if only divided."""
    return counts.where("kind in ('w', 'd')").groupBy(F.col("key").alias("token")).agg(F.sum(F.when(F.col("kind") == "w", F.col("n")).otherwise(0)).alias("n"))


def corrections(words: DataFrame) -> DataFrame:
    """``(token, repaired, score, n)``: what confusion pairs explain, best first by score; lower is better."""

    def keyed(of, keep):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key, token, n = [], [], []
                for t, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if keep(t, m):
                        own = of(t)
                        key += own
                        token += [t] * len(own)
                        n += [m] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(token, pa.string()), pa.array(n, pa.int64())], names=["key", "token", "n"])

        return run

    schema = "key string, token string, n long"
    unknown = words.mapInArrow(keyed(unknown_keys, lambda t, n: 2 <= len(t) <= 40), schema)
    known = words.where("n >= 2").mapInArrow(keyed(lexicon_keys, lambda t, n: 2 <= len(t) <= 40), schema).select("key", F.col("token").alias("repaired"), F.col("n").alias("m"))
    odd = F.col("token").rlike(r"[€!+@|(ð$£]|\d")
    pairs = unknown.join(known, "key").where((F.col("token") != F.col("repaired")) & (F.col("m") >= F.when(odd, F.col("n")).otherwise(TIMES * F.greatest("n", F.lit(1)))))
    pairs = pairs.select("token", "repaired", "n", "m").distinct()

    @F.pandas_udf(T.DoubleType())
    def weigh(seen: pd.Series, true: pd.Series) -> pd.Series:
        return pd.Series([c if (c := repair_cost(a, b)) is not None else None for a, b in zip(seen, true)], dtype="float64")

    weighed = pairs.withColumn("cost", weigh("token", "repaired")).where("cost is not null and not isnan(cost) and cost <= 1.3")
    return weighed.select("token", "repaired", (F.col("cost") * 4 - F.log(F.col("m").cast("double"))).alias("score"), F.col("m").alias("n"))


_SEEN = "kind string, id string, line int, doc string, token string, before string, after string, n long"


def _look(shared):
    """Second pass: divided words, unknown tokens, page numbers, header candidates, bigrams of contested words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trusted: dict[str, bool] = shared.value
        plain: set[str] = set()  # raw tokens that need no look
        rows: list[tuple] = []
        pairs: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows.extend(("bigram", None, None, None, None, a, b, n) for (a, b), n in pairs.items())
            cols = list(zip(*rows)) or [[]] * 8
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["kind", "id", "line", "doc", "token", "before", "after", "n"])
            rows.clear()
            pairs.clear()
            return out

        for batch in batches:
            for cid, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lines = text.split("\n")
                firsts: dict[int, str] = {}
                lasts: set[int] = set()
                skip: set[int] = set()
                if len(lines) > 1:
                    previous = ""
                    for k, line in enumerate(lines):
                        if not line or line.isspace():
                            continue
                        short = len(line) < 30
                        if short and is_page_number(line, previous):
                            rows.append(("page_number", cid, k + 1, None, None, None, None, 0))
                            skip.add(k)
                        else:
                            if line[:1] in _LINE_STARTS and (found := header_key(line)) is not None:
                                rows.append(("header", cid, k + 1, doc or "", found[0], None, None, 0))
                            previous = line
                    for k, j, a, b in divided_words(lines) if _ENDS_DIVIDED.search(text) else ():
                        lasts.add(k)
                        firsts[j] = b
                        rows.append(("divided", cid, k + 1, None, norm(a + b), f"{norm(a)}-{norm(b)}", None, 0))
                for k, line in enumerate(lines):
                    if k in skip:
                        continue
                    words = line.split()
                    if plain.issuperset(words):
                        continue
                    odd = [at for at, w in enumerate(words) if w not in plain]
                    for at in odd:
                        w = words[at]
                        token = norm(w)
                        flag = trusted.get(token)
                        if flag is False and w[0] not in "(!" and w.rstrip(".,;:")[-1:] != "!":
                            plain.add(w)
                            continue
                        if (at == 0 and firsts.get(k) == w) or (at == len(words) - 1 and k in lasts):
                            continue
                        before = norm(words[at - 1]) if at else ""
                        after = norm(words[at + 1]) if at + 1 < len(words) else ""
                        if flag:
                            pairs[before, token] += 1
                            pairs[token, after] += 1
                            continue
                        if len(token) < 2 or token.isdigit():
                            continue
                        low = w.lower()
                        if (low[0] == "(" and ")" not in low) or low[0] == "!":
                            rows.append(("word", cid, k + 1, None, low[0] + low.strip(_EDGE), before, after, 0))
                        elif low.rstrip(".,;:")[-1:] == "!":
                            rows.append(("word", cid, k + 1, None, token + "!", before, after, 0))
                        if flag is None:
                            rows.append(("word", cid, k + 1, None, token, before, after, 1))
            if len(rows) + len(pairs) > FLUSH:
                yield flush()
        yield flush()

    return run


def running_headers(counts: DataFrame) -> DataFrame:
    """``(doc, key)`` of lines that recur over a document, carry its page number, or do so elsewhere."""
    # the counts are one row per kind, document and key already
    chunks = counts.where("kind = 'c'").select("doc", F.col("n").alias("chunks"))
    lines = counts.where("kind = 'h'").select("doc", "key", "n", F.col("more").alias("numbered"))
    shape = F.regexp_replace(F.regexp_replace("key", r"[\diosbg2]{4}", "#"), " [–—-] .*$", " – #")
    # only what recurs or carries a number can be sure, and only shapes of sure lines can be so elsewhere
    often = lines.where("numbered >= 1 or n >= 3").join(chunks, "doc").where((F.col("numbered") >= 1) | (F.col("n") >= 0.1 * F.col("chunks")))
    sure = materialize(often.select("doc", "key", shape.alias("shape")), "sureheads")
    sures = sure.groupBy("shape").agg(F.count("*").alias("sures")).where("sures >= 2")
    alike = materialize(lines.select("doc", "key", shape.alias("shape")).join(sures, "shape"), "alikeheads")
    usual = alike.groupBy("shape").agg(F.count("*").alias("docs"), F.max("sures").alias("sures")).where("sures >= 0.5 * docs").select("shape")
    return sure.select("doc", "key").unionByName(alike.join(usual, "shape", "left_semi").select("doc", "key")).distinct()


def found_cases(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, line_no, noise, token, repaired, before, after)``; ``token`` is what stands in the text.

    A case met twice in a line has two rows. ``before`` and ``after`` are the neighbours of a misread word.
    """
    spark = chunks.sparkSession
    texts = _texts(chunks)
    counts = materialize(texts.mapInArrow(_count, _COUNTED).groupBy("kind", "doc", "key").agg(F.sum("n").alias("n"), F.sum("more").alias("more")), "counts")
    words = materialize(lexicon(counts), "lexicon")
    own = Window.partitionBy("token")
    # candidates within a factor of about twenty of the best stay for the context to decide
    close = corrections(words).withColumn("best", F.min("score").over(own)).where(F.col("score") <= F.col("best") + 3)
    place = F.row_number().over(own.orderBy("score", "repaired"))
    fixes = materialize(close.select("token", "repaired", "score", place.alias("place"), F.count("*").over(own).alias("rivals")), "fixes")
    contested = materialize(fixes.where("rivals > 1").select(F.col("repaired").alias("token")).distinct(), "contested")
    correct = words.where("n >= 2").join(fixes.select("token"), "token", "left_anti")
    known = correct.orderBy(F.desc("n"), "token").limit(TRUSTED).join(contested.withColumn("contested", F.lit(True)), "token", "left")
    table = known.select("token", F.coalesce("contested", F.lit(False))).toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist())))
    seen = materialize(texts.mapInArrow(_look(shared), _SEEN), "seen")

    heads = seen.where("kind = 'header'").select("id", "line", "doc", F.col("token").alias("key")).join(running_headers(counts), ["doc", "key"], "left_semi")
    heads = materialize(heads.select("id", "line"), "heads")
    pages = seen.where("kind = 'page_number'").select("id", "line")

    # contested words beyond the broadcast ones stand among the unknown tokens
    beyond = seen.where("kind = 'word' and n = 1").join(contested, "token", "left_semi")
    one = F.lit(1).cast("long").alias("n")
    bigrams = seen.where("kind = 'bigram'").select("before", "after", "n")
    bigrams = bigrams.unionByName(beyond.select("before", F.col("token").alias("after"), one)).unionByName(beyond.select(F.col("token").alias("before"), "after", one))
    bigrams = bigrams.groupBy("before", "after").agg(F.sum("n").alias("n"))
    unsure = seen.where("kind in ('word', 'divided')").select("kind", "id", "line", "token", "before", "after", "n")
    offered = unsure.where("kind = 'word'").join(fixes, "token").join(heads, ["id", "line"], "left_anti")
    left = bigrams.select("before", F.col("after").alias("repaired"), F.col("n").alias("n1"))
    right = bigrams.select(F.col("before").alias("repaired"), "after", F.col("n").alias("n2"))
    clear = offered.where("rivals = 1")
    close = offered.where("rivals > 1").join(left, ["before", "repaired"], "left").join(right, ["repaired", "after"], "left")
    close = close.withColumn("total", F.col("score") - 2 * F.log1p(F.coalesce("n1", F.lit(0)).cast("double")) - 2 * F.log1p(F.coalesce("n2", F.lit(0)).cast("double")))
    order = Window.partitionBy("id", "line", "token", "before", "after").orderBy("total", "repaired")
    close = close.withColumn("r", F.row_number().over(order)).where("r = 1")
    misread = clear.select("id", "line", "token", "repaired", "before", "after").unionByName(close.select("id", "line", "token", "repaired", "before", "after"))

    divided = unsure.where("kind = 'divided'").withColumnRenamed("before", "compound").join(fixes.where("place = 1").select("token", F.col("repaired").alias("fixed")), "token", "left")
    divided = divided.join(correct.select("token", F.lit(True).alias("whole")), "token", "left").join(correct.select(F.col("token").alias("compound"), F.lit(True).alias("compounded")), "compound", "left")
    whole = F.when(F.col("whole"), F.col("token")).when(F.col("compounded"), F.col("compound")).otherwise(F.coalesce("fixed", "token"))
    alone = [F.lit("").alias("before"), F.lit("").alias("after")]
    parts = [
        divided.select("id", "line", F.lit("hyphen").alias("noise"), "token", whole.alias("repaired"), *alone),
        misread.select("id", "line", F.lit("misread").alias("noise"), "token", "repaired", "before", "after"),
        heads.select("id", "line", F.lit("header").alias("noise"), F.lit("").alias("token"), F.lit("").alias("repaired"), *alone),
        pages.select("id", "line", F.lit("page_number").alias("noise"), F.lit("").alias("token"), F.lit("").alias("repaired"), *alone),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("id").alias("chunk_id"), F.col("line").alias("line_no"), "noise", "token", "repaired", "before", "after")


def noise_cases(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, line_no, noise, repaired)``, distinct."""
    return found_cases(chunks).select("chunk_id", "line_no", "noise", "repaired").distinct()


_JOINED = re.compile(rf"[{HYPHENS}]{{1,2}}\s*$")


def _forms(word: str) -> Iterator[tuple[str, int, int]]:
    """``(token, start, end)``: the tokens a word of the text is looked up as, and where they stand in it."""
    core, low = word.strip(_EDGE), word.lower()
    start = word.find(core)
    end = start + len(core)
    if (low[0] == "(" and ")" not in low) or low[0] == "!":
        yield low[0] + core.lower(), 0, end
    elif low.rstrip(".,;:")[-1:] == "!":
        yield core.lower() + "!", start, word.find("!", end) + 1
    yield core.lower(), start, end


def rebuild(text: str, cases: list[tuple]) -> str:
    """The text as continuous paragraphs, with ``(line_no, noise, token, repaired)`` put right.

    A misread word is put right wherever it stands in its line; if its neighbours ``before, after``
    follow in the tuple, only where it stands between them.

    Headings, list entries and label lines keep their own lines; a paragraph interrupted by a page
    break goes on.
    """
    lines = text.split("\n")
    drop = {n - 1 for n, noise, *_ in cases if noise in ("header", "page_number")}
    joined = {n - 1: w for n, noise, _, w, *_ in cases if noise == "hyphen"}
    fixes: dict[int, dict[tuple, str]] = {}
    for n, noise, token, repaired, *near in cases:
        if noise == "misread":
            fixes.setdefault(n - 1, {})[token, *near] = repaired
    # where the second part of a divided word stands
    seconds = {j: k for k, j, _, _ in divided_words(lines) if k in joined}
    out: list[str] = []
    broken = False  # a page break since the last kept line
    blank = False
    for k, line in enumerate(lines):
        s = line.strip()
        if k in drop:
            broken = True
            continue
        if not s:
            blank = True
            continue
        if k in fixes:
            own_fixes, words = fixes[k], list(re.finditer(r"\S+", s))
            near = ["", *(norm(w[0]) for w in words), ""]
            # from the end, so that places before stay
            for i in range(len(words) - 1, -1, -1):
                for token, start, end in _forms(words[i][0]):
                    repaired = own_fixes.get((token, near[i], near[i + 2]), own_fixes.get((token,)))
                    if repaired is not None:
                        at, end = words[i].start() + start, words[i].start() + end
                        new = repaired.upper() if _CODE.fullmatch(repaired) else repaired.capitalize() if s[at].isupper() or s[at] in _SYMBOLS and (at == 0 and (not out or out[-1][-1:] in ".!?:")) else repaired
                        s = s[:at] + new + s[end:]
                        break
        if k in seconds:
            # the whole word went to the line of its first part
            mark = re.match(r"\S*?([.,;:!?)\]\"”]*)(?=\s|$)", s)
            tail = mark[1] if mark else ""
            s = (s.split(None, 1) + [""])[1]
            if out and tail:
                out[-1] += tail
            if not s:
                continue
        if k in joined:
            word = re.search(r"\S+$", _JOINED.sub("", s))
            lead = re.match(r"[\"“(\[]*", word[0])[0] if word else ""
            whole = joined[k].capitalize() if word and word[0][len(lead) : len(lead) + 1].isupper() else joined[k]
            s = s[: word.start()] + lead + whole if word else s
        own = bool(_BULLET.match(s)) or s.endswith(":")
        flows = bool(out) and not out[-1].endswith(":") and not own and (k in seconds or (broken and out[-1][-1:] not in _EDGE) or (not blank and (s[:1].islower() or out[-1][-1:] not in ".!?:" or len(out[-1]) > 40)))
        heading = bool(out) and not blank and len(out[-1]) < 60 and out[-1][-1:].isalnum() and re.match(r"(?:\w+ )?\d+[.-]\d+", out[-1]) is not None
        if flows and not heading:
            out[-1] += " " + s
        else:
            out.append(s)
        broken = blank = False
    return "\n\n".join(out)


def repaired_texts(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, text)``: every text with content, its noise repaired; others as they are."""
    cases = found_cases(chunks).groupBy("chunk_id").agg(F.collect_set(F.struct("line_no", "noise", "token", "repaired", "before", "after")).alias("cases"))

    @F.pandas_udf(T.StringType())
    def put_right(text: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or ("\n" not in t and o is None) else rebuild(t, [(c["line_no"], c["noise"], c["token"], c["repaired"], c["before"], c["after"]) for c in ([] if o is None else o)]) for t, o in zip(text, own)], dtype=object)

    rows = _texts(chunks).select(F.col("id").alias("chunk_id"), "text")
    return rows.join(cases, "chunk_id", "left").select("chunk_id", put_right("text", "cases").alias("text"))
