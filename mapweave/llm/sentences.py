"""Sentence units of the prose of TeX documents, in any of their languages and scripts.

A document is masked first: a string as long as the text in which markup, formulas, comments and everything that is no
prose are stood for by marks of equal length, so that places in it are places in the text. It falls into blocks:
paragraphs of the body and the abstract, and items of lists. Within a block every character is tagged as the end of a
sentence or as inside one, by a linear-chain model decoded with Viterbi. Only characters at which a sentence can end
at all (a terminator with what closes after it; in scripts without punctuation a blank) have a choice; the chain runs
over those, the others being inside whatever the model says.

The model is trained where it is used, on list items: an item is one sentence, so in items put one after another every
joint is an end and every other place is not. No lists of abbreviations are needed for any language. For scripts that
end sentences without a mark the items are stripped of all punctuation first, so that what is learnt there are the
letters on both sides and not marks that happen to stand near.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm import tex

# Marks of the masked text.
_EOL, _GONE, _BREAK, _CMD, _SHUT = "\x02", "\x03", "\x04", "\x05", "\x06"  # comment with its line end; nothing; block end; command or brace; closing brace
_MATH, _DISPLAY, _CITE, _SIGN = "\ue001", "\ue002", "\ue003", "\ue004"

_PROSE_ENVS = r"document|abstract|itemize|enumerate"
_MATH_ENVS = r"equation|align|alignat|flalign|gather|multline|eqnarray|displaymath|math"
_ARG = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_TOKEN = re.compile(
    # Every branch starts with a plain character, so that runs of other characters are passed over at once.
    r"%(?P<comment>[^\n]*\n?)"
    r"|\{(?P<letter>\\(?:ss|SS|ae|AE|oe|OE|o|O|l|L|aa|AA|i|j)\s*\})"
    r"|\{(?P<open>)|\}(?P<shut>)"
    r"|\$(?:\$(?P<display2>.*?\$\$)|(?P<math>(?:[^$\\]|\\.)*\$))"
    r"|\\(?:"
    r"(?P<space>[,;:!/ \n\\]|q?quad(?![A-Za-z]))"
    r"|(?P<sign>[%&$#_{}])"
    r"|(?P<accent>[`'^~=.\"]\s*(?:\{\s*\\?[^\W\d_]\s*\}|\\[ij](?![A-Za-z])|[^\W\d_])|[uvHrckdb](?:\s*\{\s*[^\W\d_]\s*\}| +[^\W\d_])|(?:ss|SS|ae|AE|oe|OE|o|O|l|L|aa|AA|i|j)(?![A-Za-z])(?:\{\})?)"
    r"|(?P<math2>\(.*?\\\))"
    r"|(?P<display3>\[.*?\\\])"
    rf"|(?P<cite>(?:[A-Za-z]*cite[A-Za-z]*|[A-Za-z]*ref|url|href)\*?(?:\[[^\]]*\])*{_ARG}(?:\{{[^{{}}]*\}})?)"
    r"|(?P<off>iffalse(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\Z)|begin\{comment\}.*?(?:\\end\{comment\}|\Z))"
    rf"|(?P<display>begin\{{(?P<menv>(?:{_MATH_ENVS})\*?)\}}.*?(?:\\end\{{(?P=menv)\}}|\Z))"
    rf"|(?P<env>begin\{{(?!(?:{_PROSE_ENVS})\}})(?P<name>[^{{}}]*)\}}.*?(?:\\end\{{(?P=name)\}}|\Z))"
    r"|(?P<edge>(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?|item(?![A-Za-z])(?:[ \t]*\[[^\]\n]*\])?|(?:par|maketitle|tableofcontents|newpage|clearpage|endinput|appendix)(?![A-Za-z]))"
    rf"|(?P<head>(?:(?:sub)*section|(?:sub)?paragraph|chapter|part|title|author|date|address|affiliation|thanks|keywords|caption|usepackage|documentclass|bibliography|bibliographystyle|input|include)(?![A-Za-z])\*?\s*(?:\[[^\]]*\]\s*)*{_ARG}|input[ \t]+\S+)"
    rf"|(?P<gone>label\s*{_ARG}|footnote\s*{_ARG}|(?:(?:re)?newcommand|providecommand)\*?\s*(?:{_ARG}|\\[A-Za-z]+)\s*(?:\[[^\]]*\])*\s*{_ARG}|[gx]?def\s*\\[A-Za-z]+[^{{}}\n]*{_ARG})"
    r"|(?P<cmd>[A-Za-z@]+\*?(?:\{\}|\\[ \n])?|.))",
    re.S,
)
_LETTER_OF = re.compile(r"[^\W\d_]")


class _Mask:
    def __init__(self, macros: dict[str, str]):
        self.macros = macros

    def __call__(self, m: re.Match) -> str:
        kind, n = m.lastgroup, m.end() - m.start()
        if kind == "comment":
            return _EOL * n if m[0].endswith("\n") else _GONE * n
        if kind in ("accent", "letter"):
            letters = _LETTER_OF.findall(m[0])
            return (letters[-1] if letters else "x") * n
        if kind == "space":
            return " " * n
        if kind == "cmd":
            body = self.macros.get(m[0][1:].rstrip("{}\\ \n*"))
            if body and (first := _LETTER_OF.search(body)):
                return first[0] + "x" * (n - 1)
            return _CMD * n
        return _FILL[kind] * n


_FILL = {"off": _GONE, "display": _DISPLAY, "display2": _DISPLAY, "display3": _DISPLAY, "env": _BREAK, "math": _MATH, "math2": _MATH, "open": _CMD, "shut": _SHUT, "edge": _BREAK, "head": _BREAK, "gone": _GONE, "cite": _CITE, "sign": _SIGN}

_PARAGRAPH = re.compile(rf"{_BREAK}+|[\n{_EOL}][ \t]*\n\s*")
_BODY = re.compile(r"^(?:[^%\n\\]|\\.)*?\\begin\{document\}", re.M)
_OFF = re.compile(r"^(?:[^%\n\\]|\\[^\n])*?(\\end\{document\}|\\endinput(?![A-Za-z]))", re.M)
_NOT_START = f" \t\n\r\x0b\x0c\x85\xa0\u2002\u2003\u2009\u202f\u3000~{_EOL}{_GONE}"


class Block(NamedTuple):
    start: int
    end: int
    is_item: bool


def mask(text: str) -> tuple[str, list[Block]]:
    """The masked text, of equal length, and its blocks, trimmed."""
    flat = text.replace("\r\n", " \n").replace("\r", "\n") if "\r" in text else text
    begin = _BODY.search(flat)
    lo = begin.end() if begin else 0
    macros = tex.definitions(flat) if "\\newcommand" in flat or "\\def" in flat else {}
    over = _OFF.search(flat, lo)
    hi = over.start(1) if over else len(flat)
    masked = " " * lo + _TOKEN.sub(_Mask(macros), flat[lo:hi])
    blocks, at = [], lo
    for m in _PARAGRAPH.finditer(masked, lo):
        _add(blocks, flat, masked, at, m.start())
        at = m.end()
    _add(blocks, flat, masked, at, hi)
    return masked, blocks


def _add(blocks: list[Block], flat: str, masked: str, a: int, b: int) -> None:
    is_item = flat[a - 5 : a] == "\\item"
    while a < b and masked[a] in _NOT_START:
        a += 1
    while a < b and masked[b - 1] in _NOT_START:
        b -= 1
    if a < b and _TEXT.search(masked, a, b):
        blocks.append(Block(a, b, is_item))


_TEXT = re.compile(f"[^{re.escape(_NOT_START + _CMD + _SHUT)}]")

_OPENS = {"``": "''", '"': '"', "„": "“", "“": "”", "«": "»", "(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "【": "】"}
_MARK = re.compile(r"[`'\"„“”«»()（）\[\]「」『』【】.!?…。！？｡।॥](?:(?<=[.!?…])[.!?…]+|(?<=[。！？｡।॥])[。！？｡।॥]+|(?<=`)`|(?<=')')?")
_THAI = re.compile("[\u0e00-\u0e7f]")
_THAI_MARK = re.compile(_MARK.pattern + r"|(?<=[\u0e00-\u0e7f\ue001-\ue004\d])[ \t\n\x02\x03]+(?=[\u0e00-\u0e7f\ue001-\ue004])")
_WIDE_END = set("。！？｡।॥")
_WORD_AFTER = re.compile(r"[^\W_]+|[\ue001-\ue004]+")
_SKIP = re.compile(rf"[\s~{_EOL}{_GONE}{_CMD}{_SHUT}]*")


class Candidate(NamedTuple):
    end: int  # place after the terminator and what closes after it
    features: list[str]


def _shape(word: str) -> str:
    if not word:
        return "-"
    c = word[0]
    if "\ue001" <= c <= "\ue004":
        return "MDCS"[ord(c) - 0xE001]
    if c.isdigit():
        return "9" if len(word) < 3 else "999"
    o = ord(c)
    if o >= 0x2E80:
        return "z"
    if 0xE00 <= o < 0xE80:
        return "t"
    if 0x900 <= o < 0x980:
        return "h"
    if len(word) == 1:
        return "A" if c.isupper() else "a"
    if c.isupper():
        return "Aa"
    return "aA" if word != word.lower() else "aa"


def candidates(masked: str, block: Block) -> list[Candidate]:
    """The places in a block at which a sentence can end, with their features, in order."""
    lo, hi = block.start, block.end
    text = masked[lo:hi]
    thai = len(_THAI.findall(text)) * 3 > hi - lo
    back, size = text[::-1], hi - lo
    out: list[Candidate] = []
    stack: list[tuple[str, int]] = []
    starts = {0}
    marks = list((_THAI_MARK if thai else _MARK).finditer(text))
    i, n = 0, len(marks)
    while i < n:
        m = marks[i]
        mark = m[0]
        i += 1
        if mark in "`'":
            continue
        if mark in _OPENS or mark in ("''", "”", "»", ")", "）", "]", "」", "』", "】"):
            if stack and stack[-1][0] == mark:
                stack.pop()
            elif mark in _OPENS:
                stack.append((_OPENS[mark], m.start()))
            continue
        if mark[0].isspace() or mark[0] in "\x02\x03":
            if not thai or stack:
                continue
            end, after = m.start(), m.end()
            w1, w3 = (_WORD_AFTER.match(back, size - end) or [""])[0][::-1], (_WORD_AFTER.match(text, after) or [""])[0]
            out.append(Candidate(lo + end, ["T", "T" + _shape(w1), "T>" + _shape(w3), "T<" + w1[-2:], "T+" + w3[:2]]))
            continue
        end, closed, opener = m.end(), 0, -1
        while i < n and stack and marks[i][0] == stack[-1][0] and all(c in " \xa0 ~\x05\x06" for c in text[end : marks[i].start()]) and (end == marks[i].start() or text[end] in _SHUT or marks[i][0] == "»"):
            opener = stack.pop()[1]
            end, closed, i = marks[i].end(), closed + 1, i + 1
        while end < len(text) and text[end] == _SHUT:
            end += 1
        wide = mark[0] in _WIDE_END
        if not wide and not closed and end < len(text) and text[end] not in _NOT_START and text[end] != _CMD:
            if mark[0] == "." or not (ord(text[end]) >= 0x900 or text[end] in "\"'“„«(") and text[end] not in "`":
                continue
        after = _SKIP.match(text, end).end()
        gap = text[end:after]
        gap = "end" if after >= len(text) else "~" if "~" in gap else "n" if "\n" in gap else "s" if " " in gap else "0"
        before = _WORD_AFTER.match(back, size - m.start())
        w1 = w2 = ""
        if before:
            w1 = before[0][::-1]
            b = before.end()
            while b < size and back[b] in " .~\n":
                b += 1
            second = _WORD_AFTER.match(back, b)
            w2 = second[0][::-1] if second else ""
        following = _WORD_AFTER.match(text, after)
        if following:
            w3, n1 = following[0], _shape(following[0])
        else:
            w3 = ""
            n1 = text[after] if after < len(text) else "$"
        kind = "..." if len(mark) > 1 and mark[0] in ".…" else mark[0]
        s1, deep = _shape(w1), "d" if stack else ""
        shut = "" if not closed else "c1" if opener in starts else "c0"
        w1, w2, w3 = w1.lower()[:8], w2.lower()[:8], w3[:10]
        key = kind + shut + deep
        out.append(
            Candidate(
                lo + end,
                ["b", "k" + key, f"n{key}|{n1}", f"g{gap}|{n1}", f"g{gap}{kind}", f"s{kind}{s1}|{n1}", f"w{w1}{kind}", f"w{w1}{kind}|{n1}", f"v{w2}|{w1}{kind}", f"v{w2}|{s1}{kind}", f"x{w3}", f"y{s1}{kind}|{w3}", "D" if deep else "F"],
            )
        )
        starts.add(after)
    return out


class ChainModel:
    """Linear chain over candidates with tags inside (0) and end (1): weights per feature, and per pair of tags."""

    def __init__(self, weights: dict[str, float] | None = None, pairs: list[float] | None = None):
        self.weights, self.pairs = weights if weights is not None else dict(_PRIOR), pairs or [0.0] * 4

    def decode(self, chain: list[list[str]]) -> list[int]:
        """The best tags, by Viterbi; from the start as after an end."""
        get, (p00, p01, p10, p11) = self.weights.get, self.pairs
        s0, s1, back = -1e18, 0.0, []
        for features in chain:
            e = 0.0
            for f in features:
                e += get(f, 0.0)
            a0, a1, b0, b1 = s0 + p00, s1 + p10, s0 + p01, s1 + p11
            back.append((a1 > a0, b1 > b0))
            s0, s1 = max(a0, a1), max(b0, b1) + e
        tag, tags = int(s1 > s0), []
        for to0, to1 in reversed(back):
            tags.append(tag)
            tag = int(to1 if tag else to0)
        return tags[::-1]


# What the model starts from, and stays at where there is nothing to learn from.
_PRIOR = {
    "b": 0.5, "D": -6.0, "gend.": 2.0, "T": 4.0,
    "k.": 0.5, "k!": 1.0, "k?": 1.0, "k。": 4.0, "k！": 4.0, "k？": 4.0, "k।": 4.0, "k॥": 4.0, "k｡": 4.0,
    "n.|aa": -4.0, "n.|9": -4.0, "n.|a": -4.0, "n.|z": -4.0, "n.|h": -4.0, "n.|C": -2.0, "n...|aa": -4.0, "n...|z": -4.0, "n.|,": -4.0,
    "g~|9": -3.0, "g~|Aa": -3.0,
}


def train(chains: list[tuple[list[list[str]], list[int]]], rounds: int = 6) -> ChainModel:
    """Averaged structured perceptron: decode, and where the tags are wrong move the weights towards the right ones."""
    model = ChainModel()
    sums: dict[str, float] = {}
    pair_sums, step = [0.0] * 4, 0
    for _ in range(rounds):
        for chain, right in chains:
            step += 1
            got = model.decode(chain)
            if got == right:
                continue
            before_r = before_g = 1
            for features, r, g in zip(chain, right, got):
                if r != g:
                    for f in features:
                        model.weights[f] = model.weights.get(f, 0.0) + (r - g)
                        sums[f] = sums.get(f, 0.0) + step * (r - g)
                if (before_r, r) != (before_g, g):
                    for t, sign in ((before_r * 2 + r, 1), (before_g * 2 + g, -1)):
                        model.pairs[t] += sign
                        pair_sums[t] += step * sign
                before_r, before_g = r, g
    step += 1
    weights = {f: w - sums.get(f, 0.0) / step for f, w in model.weights.items()}
    return ChainModel({f: w for f, w in weights.items() if abs(w) > 1e-3}, [w - s / step for w, s in zip(model.pairs, pair_sums)])


_PUNCTUATION = re.compile(r"[^\w\s\u0e00-\u0e7f\ue001-\ue004\x02-\x06]")


def stripped(items: list[str]) -> list[str]:
    """Items of a script without sentence marks, without any punctuation; others as they are."""
    if len(_THAI.findall("".join(items))) * 3 <= sum(map(len, items)):
        return items
    return [x for x in (_PUNCTUATION.sub("", i).strip() for i in items) if x]


def item_chains(text: str) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Training chains of one document: its list items one after another, with the joints as the ends."""
    masked, blocks = mask(text)
    items = stripped([masked[b.start : b.end] for b in blocks if b.is_item])
    for shift in range(2):
        row = items[shift:] + items[:shift]
        if not row:
            return
        wide = sum(ord(c) >= 0x2E80 and not "\ue000" <= c <= "\uf8ff" for c in row[0]) * 2 > len(row[0])
        joined, ends = "", set()
        for k, item in enumerate(row):
            joined += item
            ends.add(len(joined))
            if k + 1 < len(row):
                joined += ("" if wide else "\n", "" if wide else " ", "\n", "" if wide else "  ")[(k + shift) % 4]
        found = candidates(joined, Block(0, len(joined), True))
        if found:
            yield [c.features for c in found], [int(c.end in ends) for c in found]


def sentences(text: str, model: ChainModel) -> list[tuple[int, int]]:
    """(start, end) of each sentence of the prose of a document, in code points, in order."""
    masked, blocks = mask(text)
    out = []
    for block in blocks:
        found = candidates(masked, block)
        at = block.start
        for c, tag in zip(found, model.decode([c.features for c in found])):
            if tag and c.end < block.end:
                out.append((at, c.end))
                at = c.end
                while masked[at] in _NOT_START:
                    at += 1
        out.append((at, block.end))
    return out


def train_on(texts: Iterable[str]) -> ChainModel:
    return train([chain for t in texts for chain in item_chains(t)])


def sentence_units(docs: DataFrame, doc_id: str, text: str, train_docs: int = 2000) -> DataFrame:
    """``doc_id, start_pos, end_pos`` of every sentence of the prose of every document.

    Prose are the paragraphs of the body (from the beginning of the document environment, or of the text, to its end)
    and of the abstract, and items of itemize and enumerate. Places count code points from 0; the end is the place
    after the sentence's last character. Null and empty texts have no sentences; a text without markup is one body;
    texts are read whole; repeated documents give their rows again.

    The model is fitted on the list items of at most ``train_docs`` documents, those first by a hash of their id among
    the five times as many that a hash threshold lets through, and of at most a quarter as many with a script that ends
    sentences without marks, which are rare, among fifty times as many; so it does not depend on how the table is cut
    up. Without list items it keeps its prior. Everything else covers all documents and needs no shuffle.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # A hash threshold first, so that each task sends on its share of the sample and not a whole one.
    n = max(1, rows.select("doc_id").count())
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))

    def first(n_docs: int, among: int, test: Column) -> DataFrame:
        few = rows.where((drawn < int(min(1.0, among * n_docs / n) * (1 << 30))) & F.contains("text", F.lit("\\item ")) & test)
        return few.withColumn("h", drawn).orderBy("h", "doc_id").limit(n_docs)

    sample = first(train_docs, 5, F.lit(True)).unionByName(first(max(1, train_docs // 4), 200, F.rlike("text", F.lit("[\u0e00-\u0e7f]"))))
    spark = docs.sparkSession

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column("text").to_pylist()]
        model = train_on(texts)
        names = list(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array(names + [f"pair{i}" for i in range(4)]), pa.array(list(model.weights.values()) + model.pairs)], names=["feature", "weight"])

    fitted = sample.select("text").coalesce(1).mapInArrow(chains, "feature string, weight double").collect()
    pairs = [0.0] * 4
    weights = {}
    for r in fitted:
        if r["feature"].startswith("pair"):
            pairs[int(r["feature"][4:])] = r["weight"]
        else:
            weights[r["feature"]] = r["weight"]
    model = spark.sparkContext.broadcast((weights, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = ChainModel(*model.value)
        for b in batches:
            ids, starts, ends = [], [], []
            for doc, body in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for s, e in sentences(body, chain) if body else ():
                    ids.append(doc)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], names=["doc_id", "start_pos", "end_pos"])

    return rows.mapInArrow(run, "doc_id bigint, start_pos bigint, end_pos bigint")
