"""The operators for training text, on small tables with nulls, empty and long texts, repeats and nothing at all."""

import random
from collections import Counter, defaultdict

import pytest

from mapweave.llm import leakage, mixing, sentences, terms, tex
from mapweave.llm.queries import PATTERN, tokenizer_file

# Terms.

FEED = "a int, b bigint, ks array<string>, vs array<string>, term string, field_name string, n int"


def test_term_counts_against_brute_force(spark):
    rng = random.Random(1)
    words = ["Ａ", "a", " A ", "b\u00a0 c", "B C", "é", "e\u0301", "", None, "ﬁ", "fi", "d"]
    rows = [(rng.choice([1, 2, None]), rng.randrange(6), None if rng.random() < 0.1 else [rng.choice(words) for _ in range(rng.randrange(4))], [rng.choice(words)], "x", "y", 3) for _ in range(120)]
    rows += rows[:10]
    often, where = Counter(), defaultdict(set)
    for a, b, *lists in (r[:4] for r in rows):
        for name, values in zip(("ks", "vs"), lists):
            for v in values or ():
                if v is not None and terms.normal_term(v):
                    often[name, terms.normal_term(v)] += 1
                    where[name, terms.normal_term(v)].add((a, b))
    n_all = len({r[:2] for r in rows})
    df = spark.createDataFrame(rows, FEED)
    got = {(r["field_name"], r["term"]): (r["n_occurrences"], r["n_records"], r["n_all_records"]) for r in terms.term_counts(df, ("a", "b"), ("ks", "vs")).collect()}
    assert got == {k: (often[k], len(where[k]), n_all) for k in often}
    bands = {(r["field_name"], r["term"]): r["band"] for r in terms.banded_terms(df, ("a", "b"), ("ks", "vs"), 3, 50).collect()}
    assert bands == {k: "rare" if len(s) <= 3 else "common" for k, s in where.items() if len(s) <= 3 or len(s) * 100 > n_all * 50}
    assert terms.term_counts(df.limit(0), ("a", "b"), ("ks", "vs")).count() == 0


# Leaks.

WORDS = [f"wor{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def leaky():
    rng = random.Random(3)
    items = [(i, text_of(rng, 30)) for i in range(6)] + [(6, "".join(chr(0x4E00 + rng.randrange(800)) for _ in range(60))), (7, "too few words here"), (8, None), (None, text_of(rng, 20)), (0, text_of(rng, 25))]
    cut = lambda i, a, n: " ".join(items[i][1].split()[a : a + n])
    han = items[6][1]
    docs = [
        (1, text_of(rng, 50) + " " + cut(0, 4, 12) + " " + text_of(rng, 50)),
        (2, text_of(rng, 50) + " " + cut(1, 3, 11) + " zzz " + text_of(rng, 50)),
        (3, r"\newcommand{\mine}{" + cut(2, 0, 6) + r"} % " + "\n" + r"\mine{} " + cut(2, 6, 7).upper().replace(" ", " \\cite{a,b} \n")),
        (4, "字" * 30 + han[10:34] + "字" * 30), (5, "字" * 30 + han[10:33] + "文" * 30),
        (6, "% " + items[3][1]), (7, None), (8, ""), (9, "too few words here too few words here"),
        (10, text_of(rng, 3000) + items[4][1] + text_of(rng, 3000) + items[5][1][:-2] + "?"), (11, items[10][1]), (12, items[0][1] + " " + items[10][1]),
        (13, cut(0, 4, 12).replace("x w", "xw")), (None, items[0][1]),
    ]
    return docs + docs[:2], items, {(1, 0), (3, 2), (4, 6), (6, 3), (10, 4), (10, 5), (11, 0), (12, 0), (13, 0)}


def test_leaks_are_found_with_any_filter(spark, leaky):
    docs, items, want = leaky
    df = spark.createDataFrame([(d, t, "a", 0) for d, t in docs], "doc_id bigint, text string, item_id string, h int")
    idf = spark.createDataFrame([(i, t, 1) for i, t in items + items[:1]], "item_id bigint, item_text string, doc_id int")
    for bits in (26, 16):  # a filter so full that it lets nearly everything through changes nothing
        got = [tuple(r) for r in leakage.leaked_items(df, idf, "doc_id", "text", "item_id", "item_text", bits).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert leakage.leaked_items(df.limit(0), idf, "doc_id", "text", "item_id", "item_text").count() == 0
    assert leakage.leaked_items(df, idf.limit(0), "doc_id", "text", "item_id", "item_text").count() == 0


def test_winnowing_keeps_a_hash_of_every_shared_span():
    rng = random.Random(5)
    for _ in range(200):
        k, w = rng.choice([(5, 4), (14, 11), (3, 1)])
        span = "".join(rng.choice("ab") for _ in range(k + w - 1))
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(40))) + span + "".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(2)]
        a, b = (set(leakage.kept_hashes(t, k, w)[1].tolist()) for t in texts)
        assert a & b


def test_macros_however_deep():
    text = "".join(rf"\newcommand{{\m{'abcdefgh'[i]}}}{{\m{'abcdefgh'[i + 1]}}}" for i in range(7)) + r"\newcommand{\mh}{done} \ma"
    assert tex.expand(text, tex.definitions(text)).endswith("done")
    loop = r"\newcommand{\x}{\x\x\x} \x"
    assert len(tex.expand(loop, tex.definitions(loop))) < 20_000


# Mixing.


def test_token_counts_are_those_of_the_tokenizer():
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=mixing.ranks_of(open(tokenizer_file(), "rb").read()), special_tokens={})
    count = mixing.token_counter(open(tokenizer_file(), "rb").read(), PATTERN)
    for text in ("", "  a b\n\n c'd ", "naïve 文字 ไทย\t\t", "x" * 3000, " \u3000 y\u00a0z  ", "<|endoftext|>"):
        assert count(text) == len(enc.encode_ordinary(text))


def test_shares_and_caps(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 40))), "big" if i % 10 else "small") for i in range(600)]
    docs += [(900, "x y", None), (901, None, "big"), (902, "", "small"), (903, "never asked for", "other")]
    ddf = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, n_tokens int")
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 9), ("other", None, 2), (None, 0.1, 1), ("big", 0.4, 5)]
    tdf = spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int")
    draws, report = mixing.mix_sources(ddf, tdf, open(tokenizer_file(), "rb").read(), PATTERN)
    rows = {r["doc_id"]: r for r in draws.collect()}
    assert len(rows) == draws.count() and all(r["copies"] <= {"big": 1, "small": 3}[r["source"]] for r in rows.values())
    told = {r["source"]: r for r in report.collect()}
    assert set(told) == {"big", "small", "absent", "other"}
    total = sum(r["n_tokens"] * r["copies"] for r in rows.values())
    for s, share in (("big", 0.5), ("small", 0.3)):
        used = sum(r["n_tokens"] * r["copies"] for r in rows.values() if r["source"] == s)
        assert told[s]["n_tokens_used"] == used and abs(told[s]["actual_share"] - used / total) < 1e-12
        assert abs(used / total - share / 0.8) < 0.002  # the source without documents cannot give its share
    assert told["absent"]["n_docs_used"] == told["other"]["n_docs_used"] == 0
    again = mixing.mix_sources(ddf.repartition(7), tdf, open(tokenizer_file(), "rb").read(), PATTERN)[0]
    assert {(r["doc_id"], r["copies"]) for r in again.collect()} == {(k, r["copies"]) for k, r in rows.items()}
    assert mixing.mix_sources(ddf.limit(0), tdf, open(tokenizer_file(), "rb").read(), PATTERN)[0].count() == 0
    assert mixing.mix_sources(ddf, tdf.limit(0), open(tokenizer_file(), "rb").read(), PATTERN)[0].count() == 0


def test_budget_is_filled_as_far_as_lengths_allow():
    rng = random.Random(9)
    for _ in range(150):
        lengths = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        budget = rng.randrange(0, 60)
        reach = {0}
        for size, n in lengths.items():
            reach = {r + size * k for r in reach for k in range(n + 1)}
        got = mixing.fit_lengths(lengths, budget)
        assert all(0 < n <= lengths[size] for size, n in got.items())
        assert sum(size * n for size, n in got.items()) == max(r for r in reach if r <= budget)


# Sentences.


def test_sentences_of_documents(spark):
    rng = random.Random(17)
    train = "\n".join(rng.choice([f"\\item The case of Mr. Bar{i} is open in Eq. {i} of it.", f"\\item Few saw {rng.choice(WORDS)}.", f"\\item Our {rng.choice(WORDS)}, see Fig. {i}, is {rng.choice(WORDS)}.", f"\\item Does Dr. {rng.choice(WORDS).title()} know?", f"\\item Go {rng.choice(WORDS)}!", f"\\item Is {rng.choice(WORDS)} so?", f"\\item It is {rng.choice(WORDS)} and {rng.choice(WORDS)}."]) for i in range(150)) + "\n"
    body = "Our first result is short. One is here, see Eq. 5 of it. Two is\nthere!  % no. Not this.\nIs there a third?"
    docs = [(k, f"\\begin{{document}}\\begin{{itemize}}{train}\\end{{itemize}}\\end{{document}}") for k in range(8)]
    docs += [(20 + k, "\n".join(["\\item " + "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(6)) + rng.choice("。！？") for _ in range(20)] + [""])) for k in range(4)]
    docs += [(50, f"\\title{{No. Prose.}}\n\\begin{{document}}\n{body}\n\n\\section{{Not. This.}}\nLast one.\\end{{document}} Off. Off."), (51, None), (52, ""), (53, "   \n"), (54, "第一句。第二句！“第三句。”"), (55, "a " * 20_000 + "end. Next.")]
    df = spark.createDataFrame([(*d, 0) for d in docs + docs[-1:]], "doc_id bigint, text string, start_pos int")
    rows = sorted({tuple(r) for r in sentences.sentence_units(df, "doc_id", "text").collect() if r["doc_id"] >= 50})
    text = dict(docs)
    got = [text[d][a:b] for d, a, b in rows if d == 50]
    assert got == ["Our first result is short.", "One is here, see Eq. 5 of it.", "Two is\nthere!", "Is there a third?", "Last one."]
    assert [text[54][a:b] for d, a, b in rows if d == 54] == ["第一句。", "第二句！", "“第三句。”"]
    assert sum(b - a for d, a, b in rows if d == 55) >= 40_009 and not any(d in (51, 52, 53) for d, _, _ in rows)
    assert sentences.sentence_units(df.limit(0), "doc_id", "text").count() == 0


def test_scripts_without_marks_are_learnt_from_stripped_items():
    """A blank within an item, always after the same letters, is told from one between items; marks are gone from training."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("กขคงจชซ") for _ in range(rng.randrange(3, 7)))
    items = [word() + "ฟผฝ " + word() if rng.random() < 0.5 else word() + word() for _ in range(200)]
    marked = [i + "!" if k % 2 else "(" + i + ")" for k, i in enumerate(items)]
    assert sentences.stripped(marked) == items
    doc = lambda rows: "\\begin{document}\n\\begin{itemize}\n" + "\n".join("\\item " + r for r in rows) + "\n\\end{itemize}\n\\end{document}"
    model = sentences.train_on([doc(marked[:150])])
    prose = " ".join(items[150:])
    blanks = {i for i, c in enumerate(prose) if c == " "}
    right = {i for i in blanks if prose[i - 3 : i] != "ฟผฝ"}
    ends = lambda m: {b for _, b in sentences.sentences(prose, m)} & blanks
    wrong = len(ends(model) ^ right)
    assert wrong <= 0.15 * len(blanks) < len(ends(sentences.ChainModel()) ^ right)


def test_viterbi_finds_the_best_tags():
    rng = random.Random(13)
    for _ in range(100):
        model = sentences.ChainModel({f: rng.uniform(-2, 2) for f in "abcd"}, [rng.uniform(-1, 1) for _ in range(4)])
        chain = [[rng.choice("abcd")] for _ in range(rng.randrange(1, 8))]
        score = lambda tags: sum(model.weights[c[0]] * t for c, t in zip(chain, tags)) + sum(model.pairs[a * 2 + b] for a, b in zip([1, *tags], tags))
        best = max(score([n >> i & 1 for i in range(len(chain))]) for n in range(2 ** len(chain)))
        assert abs(score(model.decode(chain)) - best) < 1e-9


def test_queries_are_registered():
    import __spark_entry__

    assert {"p1_found", "p8_found", "p9_mix_draws", "p9_mix_shares", "p10_found"} <= set(__spark_entry__.queries())
