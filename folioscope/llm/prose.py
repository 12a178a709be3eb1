"""Keyword-stuffed and link-list pages, by the perplexity of function-word and word-class sequences.

A line becomes a sequence of symbols: function words stand for themselves; where there is no list of them, words of up to
three letters are taken for function words, which holds in most languages that put spaces between words; other words,
links, tags, codes, numbers, separators and ends of sentences stand for their class. An n-gram model of such sequences,
counted over the prose of all distinct texts of the corpus, predicts the class of each symbol from the symbols before it,
backing off to their classes. Lines of keywords, links, menus, tags and product codes come out abnormally high.

Key phrases that are said again and again, as they are or forced into sentences, come out abnormally low under a second
model: the page's own content words, each predicted from its other uses on the page.

What is abnormal is measured on prose: more than ``HIGH`` times the bits that 99 in 100 sentences of held-out texts stay
under, or less than ``LOW`` times what 99 in 100 sentences have on pages with as many content words. A page is flagged if
more than half of its characters stand in such lines. Without prose to compare with, nothing is flagged. Code, tables and
tables of contents are ordinary text; scripts without spaces and without a list are never judged by the first model.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread_join, stored

#: Pairs of symbols whose followers are sent to the driver and back to the workers, at most; those of other pairs are joined.
KEPT = 1 << 20
#: A line is abnormal from so many times the bits of the held-out sentence at the 99th of 100 places.
HIGH = 2.4
#: And up to so many times the bits, under the page's own content words, of the sentence at the first of 100 places.
LOW = 0.7
#: Least share of each context's own counts that goes to the shorter context: prose of another kind than the corpus's stays likely.
BACK_OFF = 0.4
#: Of 256 distinct texts, so many are held out of the counts to find the limits.
HELD_OUT = 26

# Function words of the languages of the corpus, in natural order.
FUNCTION_WORDS = {
    "en": """a about after all also although an and any are as at be because been before but by can could did do does down each
        every few for from had has have he her here his how i if in into is it its just let like many may might more most must
        my no nobody nor not of off on once one only or other our out over own same several she should since so some someone
        such than that the their them then there these they this those though through to too under unless until up upon us very
        was we were what when where whether which while who why will with without would yet you your""",
    "de": """aber alle als also am an auch auf aus bei beim bevor bis da damit danach das dass dem den denn der des die dies diese
        dieser doch dort durch ein eine einem einen einer eines er es etwas falls für gegen gleich hat haben ich ihr im immer in
        ist ja jede jeder jetzt kann kein keine leer man mehr mit nach neben nicht nichts niemand noch nun nur ob obwohl oder
        ohne sehr sein seine sich sie sind so sobald solange sonst um und uns unter vom von vor warum was weil wenn wer wie wir
        wird wurde wurden zu zum zur zwischen außer darf""",
    "fr": """à afin alors après au aucun aussi autre aux avant avec car ce cela ces cet cette chaque comme dans de depuis des deux
        donc dont du elle en encore entre est et était eu il ils je la le les leur lors mais même moins ne ni nous où ou par
        parce pas pendant peu plus pour pourquoi près puis quand que quel quelque qui sans se sera seul si son sont sous sur
        tous tout toute très trop un une vers votre vous y n l d s c j qu""",
    "es": """a al algo ante antes aunque bajo cada casi como con cuando cual de del desde después donde dos el él ella ellos en
        entre es esa ese eso esta está están este esto fue ha hasta hay justo la las le lo los más me menos mi mientras muy nada
        ni no nos o para pero poco por porque pues que qué quien se según ser si sí sin sino sobre solo son su sus también
        tan tanto todo todos tras un una unas uno unos y ya""",
}
_WORDS = {w: i for i, w in enumerate(sorted({w for line in FUNCTION_WORDS.values() for w in line.split()}))}

# Particles and endings of Korean words, and function characters of Chinese.
KOREAN_ENDINGS = frozenset("은는이가을를에의로와과도다고서며지면게한할인")
CHINESE_FUNCTION = "的了在是和有不這为為也就與与及或等以于於上中對对從从把將将到而其之我你他她它們们可能會会要如若"

# Classes of symbols, and the numbers of the symbols that aren't function words or Japanese endings.
_CLASSES = ("start", "end", "function", "word", "number", "stop", "comma", "colon", "dash", "link", "tag", "html", "code")
_CLASS = {c: i for i, c in enumerate(_CLASSES)}
_BASE = len(_WORDS)
_KIND = {k: _BASE + i for i, k in enumerate(("start", "end", "short", "particle", "word", "name", "number", "stop", "comma", "colon", "dash", "link", "tag", "html", "code", "kanji"))}
_KANA = _BASE + len(_KIND)
_CLASS_OF = np.full(_KANA + 1, _CLASS["function"], np.int64)
for _k, _n in _KIND.items():
    _CLASS_OF[_n] = _CLASS["word" if _k in ("kanji", "name") else "function" if _k in ("short", "particle") else _k]
#: Flags of a piece: prose to count, script that isn't judged by the first model.
SENTENCE, APART = 1, 2

_TOKEN = re.compile(
    r"[A-Za-zÀ-ɏ]+(?=[\s,;!?)]|\.(?!\S)|\Z)"  # most words, before what costs more to tell apart
    r"|\[[^\]\n]*\]\([^)\s]*\)|<a\s[^>]*>[^<\n]*</a>|(?:https?|ftp)://[^\s<>()\]]+|www\.[^\s<>()\]]+"  # links
    r"|[#@][^\W_][\w-]*"  # tags
    r"|</?[A-Za-z][^<>\n]*>|&[A-Za-z]+;|&#\d+;"
    r"|`[^`\n]*`"
    r"|[^\W_]*\d[\w]*[-_][\w-]*|[^\W\d_]+[-_]\d[\w-]*|[^\W_]+_[\w]+"  # codes and identifiers
    r"|\d+(?:[.,:]\d+)*"
    r"|[぀-ヿ㐀-䶿一-鿿々ｦ-ﾟ]+"
    r"|[^\W\d_぀-ヿ㐀-䶿一-鿿ｦ-ﾟ]+\d*"
    r"|[.!?](?!\S)|[。？！,、，;；:：|·•»—–]|(?<!\S)[-/*>](?!\S)"
)
_IDENTIFIER = re.compile(r"[^\W\d]+$")
_PARTS = re.compile(r"[ぁ-ゖ]+|[ァ-ヿｦ-ﾟ]+|[㐀-䶿一-鿿々]+|.")
_HAN_PARTS = re.compile(rf"[{CHINESE_FUNCTION}]|[^{CHINESE_FUNCTION}]+")
_KANA_SEEN = re.compile(r"[ぁ-ヿｦ-ﾟ]")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
_LETTERS = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
_CONTENTS = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+\[[^\]]*\]\(#[^)]*\)\s*$")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_LEAD = re.compile(r"^\s*(?:[-*+>]|\d+[.)]|#{1,6})\s+")
_BREAK = re.compile(r"([.!?])\s+")
_LINE = re.compile(r"\r\n|\r|\n")
_HEAD = re.compile(r"^\s{0,3}#{1,6}\s\S.{0,100}$|^\s*\*\*[^*]{1,60}\*\*:?\s*$|^\s*`[^`]*`\s*$")

_STOPS, _COMMAS, _COLONS, _DASHES = ".!?。？！", ",、，", ";；:：", "|·•»—–-/*>"


def _kana(text: str) -> int:
    """Number, below 2^26, of an ending in hiragana: its first four letters as digits."""
    n = 0
    for c in text[:4]:
        n = n * 87 + ord(c) - 0x3040
    return _KANA + n


def _entry(token: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Symbols and content words of a token."""
    c = token[0]
    if c in "[<" or token.startswith(("http", "ftp:", "www.")) and (":" in token or token[3] == "."):
        if c == "<" and not token.startswith("<a"):
            return (_KIND["html"],), ()
        return (_KIND["link"],), tuple(_LETTERS.findall(token.lower().split("](")[0]))
    if c in "#@":
        return (_KIND["tag"],), tuple(_LETTERS.findall(token.lower()))
    if c == "&":
        return (_KIND["html"],), ()
    if c == "`":
        return (_KIND["word"],), ()
    for marks, kind in ((_STOPS, "stop"), (_COMMAS, "comma"), (_COLONS, "colon"), (_DASHES, "dash")):
        if c in marks:
            return (_KIND[kind],), ()
    if ("-" in token or "_" in token) and not _IDENTIFIER.match(token):
        return (_KIND["code"],), ()
    if c.isdigit():
        return (_KIND["number"],), (token,)
    low = token.lower()
    if low in _WORDS:
        return (_WORDS[low],), ()
    if "가" <= c <= "힣":
        return ((_KIND["particle"],), ()) if len(token) > 1 and token[-1] in KOREAN_ENDINGS else ((_KIND["word"],), (token,))
    if "぀" <= c <= "鿿" or "ｦ" <= c <= "ﾟ":
        if not _KANA_SEEN.search(token):
            parts = _HAN_PARTS.findall(token)
            return tuple(_KIND["particle"] if x in CHINESE_FUNCTION else _KIND["kanji"] for x in parts), tuple(x for x in parts if x not in CHINESE_FUNCTION)
        parts = _PARTS.findall(token)
        return tuple(_kana(x) if "ぁ" <= x[0] <= "ゖ" else _KIND["kanji"] for x in parts), tuple(x for x in parts if not "ぁ" <= x[0] <= "ゖ")
    if len(token) <= 3 and token == low:
        return (_KIND["short"],), ()
    return (_KIND["word" if token == low or c == low[0] else "name"],), (low,)


class _Entries(dict):
    """Entries of tokens, remembered for as many as fit."""

    def __missing__(self, token: str):
        e = _entry(token)
        if len(token) < 40 and len(self) < 1 << 17:
            self[token] = e
        return e


_ENTRIES = _Entries()


def symbols(piece: str) -> tuple[list[int], list[str]]:
    """Numbers of the symbols of a piece, and its content words in lower case."""
    tokens = _TOKEN.findall(piece.lower() if piece.isupper() else piece)
    if not tokens:
        return [], []
    if tokens[0][0].isupper():  # a capital at the beginning says nothing
        tokens[0] = tokens[0].lower()
    out: list[int] = []
    content: list[str] = []
    for s, c in map(_ENTRIES.__getitem__, tokens):
        out += s
        content += c
    return out, content


def lines(text: str):
    """(kind, line): kind is text, code (fenced, a table row, a heading or an entry of the page's own contents) or blank."""
    fence = ""
    for line in _LINE.split(text):
        m = _FENCE.match(line)
        if fence:
            if m and m.group(1).startswith(fence):
                fence = ""
            yield "code", line
        elif m:
            fence = m.group(1)
            yield "code", line
        elif not line.strip():
            yield "blank", line
        elif _TABLE.match(line) or _CONTENTS.match(line) or _HEAD.match(line):
            yield "code", line
        else:
            yield "text", line


def _sentences(line: str) -> list[str]:
    """A line cut behind the ends of its sentences."""
    line = _BREAK.sub(r"\1\n", line)
    for mark in "。！？":
        if mark in line:
            line = line.replace(mark, mark + "\n")
    return line.split("\n")


def _sentence(piece: str, code: list[int], content: list[str]) -> bool:
    """Whether a piece is prose to count: listed function words or Japanese endings among its words, an end mark, and words that don't repeat."""
    if len(piece) < 20 or piece[-1] not in ".!?。？" or len(set(content)) < 0.7 * len(content):
        return False
    function = sum(x < _BASE or x >= _KANA for x in code)
    return function >= 3 and function >= 0.25 * len(code)


def parse(text: str | None) -> tuple[int, int, list[int], list[int], list[int], list[float], list[int]]:
    """What of a text doesn't depend on the model: characters, content words, and of each piece the characters, symbols,
    flags and bits under the page's own content words (nothing is abnormal without two of them: 99), and the symbols."""
    if not text or not text.strip():
        return 0, 0, [], [], [], [], []
    pieces, said, chars, code = [], Counter(), 0, []
    for kind, line in lines(text):
        if kind == "blank":
            continue
        chars += len(line.strip())
        if kind == "code":
            continue
        for piece in _sentences(_LEAD.sub("", line)):
            piece = piece.strip()
            if not piece:
                continue
            s, content = symbols(piece)
            if not s:
                continue
            pieces.append((len(piece), len(s), content, SENTENCE * _sentence(piece, s, content) + APART * bool(_UNSPACED.search(piece))))
            code += s
            said.update(content)
    total = sum(said.values())
    worth = {w: log2(total / max(c - 1, 0.5)) for w, c in said.items()}
    own = [sum(map(worth.__getitem__, p[2])) / len(p[2]) if len(p[2]) > 1 else 99.0 for p in pieces]
    return chars, total, [p[0] for p in pieces], [p[1] for p in pieces], [p[3] for p in pieces], own, code


def _padded(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of pieces, each with three starts before and an end after it, and the place of each piece's first start."""
    starts = np.cumsum(n + 4) - (n + 4)
    x = np.full(int((n + 4).sum()), _KIND["start"], np.int64)
    free = np.ones(len(x), bool)
    free[starts] = free[starts + 1] = free[starts + 2] = free[starts + n + 3] = False
    x[starts + n + 3] = _KIND["end"]
    x[free] = code
    return x, starts


def _contexts(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Places that are predicted, their contexts of no, one, two and three classes and of two symbols, and their classes."""
    predicted = np.ones(len(x), bool)
    predicted[starts] = predicted[starts + 1] = predicted[starts + 2] = False
    at = np.flatnonzero(predicted)
    c = _CLASS_OF[np.minimum(x, _KANA)]
    one, two = c[at - 1], c[at - 2] << 4 | c[at - 1]
    return at, [np.zeros(len(at), np.int64), one, two, c[at - 3] << 8 | two, x[at - 2] << 26 | x[at - 1]], c[at]


def _bucket(total: np.ndarray) -> np.ndarray:
    """Pages by content words, in powers of two."""
    return np.log2(np.maximum(total, 1)).astype(np.int64)


def _sums(kind: int, key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """(kind, key, value, n): how often each key and value of up to four bits come together."""
    both, n = np.unique(key << 4 | value, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(both >> 4), pa.array((both & 15).astype(np.int32)), pa.array(n.astype(np.int64))], ["kind", "key", "value", "n"])


def _pieces(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    lists = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return [c.flatten().to_numpy(zero_copy_only=False) for c in lists]


_COUNTS = "kind int, key bigint, value int, n bigint"
_STEPS = 64  # of a bit, in histograms


def _count(batches):
    """N-grams of the sentences of texts that aren't held out (kinds 0 to 4) and a histogram of bits under own words (kind 5), per batch."""
    for batch in batches:
        n, flags, own, code = _pieces(batch, ("sizes", "flags", "own", "code"))
        n, code = n.astype(np.int64), code.astype(np.int64)
        lists = batch.column(batch.schema.get_field_index("sizes"))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        sentence = flags & SENTENCE > 0
        total = batch.column(batch.schema.get_field_index("total")).to_numpy()
        some = sentence & (own < 90)
        yield _sums(5, _bucket(total)[doc[some]] << 12 | np.minimum((own[some] * _STEPS).astype(np.int64), 4095), np.zeros(int(some.sum()), np.int64))
        kept = np.array([k[0] >= HELD_OUT for k in batch.column(batch.schema.get_field_index("key")).to_pylist()])
        chosen = sentence & kept[doc] if len(doc) else sentence
        if chosen.any():
            _, contexts, c = _contexts(*_padded(code[np.repeat(chosen, n)], n[chosen]))
            for kind, key in enumerate(contexts):
                yield _sums(kind, key, c)


def _at(hist: dict[int, int], share: float) -> float:
    """The value, in bits, that a share of a histogram stays under."""
    need, seen = share * sum(hist.values()), 0
    for k in sorted(hist):
        seen += hist[k]
        if seen >= need:
            return (k + 0.5) / _STEPS
    return 0.0


class Model:
    """Classes of symbols after their contexts, from the longest context on, as arrays that can be sent to the workers."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """``counted``: key, class and count of each kind of context."""
        self.kinds = [self.arrays(*c) for c in counted]
        #: Counts (key, value, n) of the pairs of symbols beyond ``KEPT``, which stay in a table; None without any.
        self.rest: DataFrame | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rest": None}

    @staticmethod
    def arrays(key: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of counts of one kind of context: its keys, and of each the sum, the number of classes and the count of each class."""
        keys, at = np.unique(key, return_inverse=True)
        total, kinds = np.bincount(at, n, len(keys)), np.bincount(at, minlength=len(keys))
        table = np.zeros((len(keys), 16), np.float32)
        table[at, value] = n
        return keys, total.astype(np.float32), kinds.astype(np.float32), table

    @property
    def empty(self) -> bool:
        return not len(self.kinds[0][0])

    def bits(self, code: np.ndarray, n: np.ndarray, *rest: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Mean bits of each piece, its end included; ``code`` holds the symbols of pieces of ``n`` each, ``rest`` the pairs beyond ``KEPT``."""
        if not len(n):
            return np.zeros(0)
        x, starts = _padded(code, n)
        at, contexts, c = _contexts(x, starts)
        p = np.full(len(at), 1 / len(_CLASSES))
        # A pair of symbols is either in the model or among the rest, so the order of these two doesn't matter.
        for (keys, total, kinds, table), key in zip([*self.kinds, *rest], [*contexts, contexts[-1]]):
            if not len(keys):
                continue
            row = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = keys[row] == key
            most, others = total[row], 4 + kinds[row]
            w = np.maximum(BACK_OFF, others / (most + others))
            p = np.where(there, (1 - w) * table[row, c] / most + w * p, p)
        bits = np.zeros(len(x))
        bits[at] = -np.log2(p)
        return np.add.reduceat(bits, starts) / (n + 1)


class Limits:
    """From which bits on a piece is abnormally high, and by the content words of its page, to which it is abnormally low."""

    def __init__(self, high: float, low: dict[int, float]) -> None:
        self.high = high
        # A size of page that no sentence was found on has the limit of the next smaller one.
        self.low = np.zeros(64)
        for b in range(64):
            self.low[b] = low.get(b, self.low[b - 1] if b else 0.0)


def _with_rest(table: DataFrame, model: Model) -> DataFrame:
    """Parsed texts beside ``rest``: the counts of those pairs of symbols of theirs that are beyond ``KEPT``; as it is without any."""
    if model.rest is None:
        return table

    def run(batches):
        often = model.kinds[-1][0]
        for batch in batches:
            n, code = (x.astype(np.int64) for x in _pieces(batch, ("sizes", "code")))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            pair = _contexts(*_padded(code, n))[1][-1]
            keys, at = np.unique(pair, return_inverse=True)
            met = np.unique(at * batch.num_rows + np.repeat(doc, n + 1))
            row = np.minimum(np.searchsorted(often, keys), max(len(often) - 1, 0))
            beyond = often[row] != keys if len(often) else np.ones(len(keys), bool)
            met = met[beyond[met // max(batch.num_rows, 1)]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(met % max(batch.num_rows, 1))), pa.array(keys[met // max(batch.num_rows, 1)])], ["key", "pair"])

    met = table.select("key", "sizes", "code").mapInArrow(run, "key binary, pair bigint").distinct()
    rest = model.rest.select(F.col("key").alias("pair"), "value", "n")
    found = met.join(rest, "pair").groupBy("key").agg(F.collect_list(F.struct("pair", "value", "n")).alias("rest"))
    return spread_join(table, found, ["key"])


def _rest(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``Model.bits`` takes of the counts that ``_with_rest`` gives the texts of a batch."""
    at = batch.schema.get_field_index("rest")
    if at < 0:
        return []
    got = batch.column(at).flatten()
    pair, value, n = (got.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    one = np.unique(pair << 4 | value, return_index=True)[1]
    return [Model.arrays(pair[one], value[one], n[one])]


def train(parsed: DataFrame) -> tuple[Model, Limits]:
    """The model and its limits, from the sentences of all distinct texts of a table of parsed ones.

    The executors count; the driver gets sums: of contexts of classes at most 16^4, of pairs of symbols the ``KEPT`` most
    frequent, and histograms. The counts of all other pairs stay in a table and are joined to the texts that have them.
    Texts whose hash falls into ``HELD_OUT`` of 256 give the high limit and no counts.
    """
    wanted = ["key", "total", "sizes", "flags", "own", "code"]
    once = parsed.where(F.exists("flags", lambda f: f.bitwiseAND(SENTENCE) > 0)).select(*wanted).dropDuplicates(["key"])
    counts = stored(once.mapInArrow(_count, _COUNTS).groupBy("kind", "key", "value").agg(F.sum("n").alias("n")))

    def columns(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = rows.select("key", "value", "n").toArrow()
        return tuple(got.column(i).to_numpy().astype(np.int64) for i in range(3))

    pairs = counts.where("kind = 4")
    rest = None
    if pairs.select("key").distinct().count() > KEPT:
        often = stored(pairs.groupBy("key").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "key").limit(KEPT).select("key"))
        pairs, rest = pairs.join(often, "key", "left_semi"), stored(pairs.join(often, "key", "left_anti"))
    model = Model([*(columns(counts.where(F.col("kind") == k)) for k in range(4)), columns(pairs)])
    model.rest = rest
    low: dict[int, dict[int, int]] = {}
    for key, _, n in zip(*columns(counts.where("kind = 5"))):
        low.setdefault(int(key) >> 12, {})[int(key) & 4095] = int(n)
    if model.empty:
        return model, Limits(np.inf, {})

    def held(batches):
        for batch in batches:
            n, flags, code = _pieces(batch, ("sizes", "flags", "code"))
            n, chosen = n.astype(np.int64), flags & SENTENCE > 0
            h = model.bits(code.astype(np.int64)[np.repeat(chosen, n)], n[chosen], *_rest(batch))
            yield _sums(6, np.minimum((h * _STEPS).astype(np.int64), 4095), np.zeros(len(h), np.int64))

    apart = once.where(F.conv(F.hex(F.substring("key", 1, 1)), 16, 10).cast("int") < HELD_OUT)
    hist = {int(k): int(n) for k, _, n in zip(*columns(_with_rest(apart, model).mapInArrow(held, _COUNTS).groupBy("kind", "key", "value").agg(F.sum("n").alias("n"))))}
    if not hist:  # too few texts to hold any out
        hist = {int(k): int(n) for k, _, n in zip(*columns(_with_rest(once, model).mapInArrow(held, _COUNTS).groupBy("kind", "key", "value").agg(F.sum("n").alias("n"))))}
    return model, Limits(HIGH * _at(hist, 0.99), {b: LOW * _at(h, 0.01) for b, h in low.items()})


def judge(model: Model, limits: Limits, total: np.ndarray, doc: np.ndarray, length: np.ndarray, n: np.ndarray, flags: np.ndarray, own: np.ndarray, code: np.ndarray, *rest: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each page in abnormal pieces, and the mean bits per symbol of each page."""
    h = model.bits(code, n, *rest) if not model.empty else np.zeros(len(n))
    odd = (h >= limits.high) & (flags & APART == 0) | (own <= limits.low[_bucket(total)[doc]] if len(doc) else False)
    add = lambda w: np.bincount(doc, w, len(total))
    return add(length * odd), add(h * (n + 1)) / np.maximum(add(n + 1), 1)


_NAMES = ["chars", "total", "lengths", "sizes", "flags", "own", "code"]
_PARSED = "doc_id bigint, key binary, chars int, total int, lengths array<int>, sizes array<int>, flags array<int>, own array<float>, code array<int>"


def parsed(docs: DataFrame) -> DataFrame:
    """What ``parse`` gives of each document, beside doc_id and a key of its text, as a stored table: texts are parsed once."""
    ship(docs.sparkSession)
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int32())]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
            got = [parse(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *(pa.array([g[i] for g in got], t) for i, t in enumerate(kinds))], ["doc_id", "key", *_NAMES])

    return stored(docs.select("doc_id", "text").mapInArrow(run, _PARSED))


def scored(table: DataFrame, model: Model, limits: Limits) -> DataFrame:
    """(doc_id, odd_share, bits, own_bits) of a table of parsed documents under a model."""

    def run(batches):
        for batch in batches:
            length, n, flags, own, code = _pieces(batch, ("lengths", "sizes", "flags", "own", "code"))
            n, code = n.astype(np.int64), code.astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(3).offsets.to_numpy()))
            chars, total = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            odd, bits = judge(model, limits, total, doc, length, n, flags, own, code, *_rest(batch))
            some = own < 90
            have = np.bincount(doc[some], minlength=batch.num_rows)
            mean = np.bincount(doc[some], own[some], batch.num_rows) / np.maximum(have, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odd / np.maximum(chars, 1)), pa.array(bits), pa.array(mean, mask=have == 0)], ["doc_id", "odd_share", "bits", "own_bits"])

    whole = _with_rest(table, model)
    return whole.select("doc_id", *_NAMES, *(["rest"] if "rest" in whole.columns else [])).mapInArrow(run, "doc_id bigint, odd_share double, bits double, own_bits double")


def spam_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, odd_share, bits, own_bits) of each document; null, empty and blank texts score 0.

    ``odd_share`` is the share of characters in abnormal pieces, ``bits`` the mean under the model, ``own_bits`` under the
    page's own content words (null without any). The model is counted over all distinct texts, so copies change no score.
    An empty corpus gives no rows.
    """
    table = parsed(docs)
    return scored(table, *train(table))


def spam(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id): documents of whose characters more than ``share`` stand in lines of abnormal perplexity."""
    return spam_scores(docs).where(F.col("odd_share") > share).select("doc_id").distinct()
