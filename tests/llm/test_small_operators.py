"""Each operator against a brute-force version on small tables with nulls, empty and repeated rows, ties and extra columns."""

import base64
import contextlib
import hashlib
import math
import random
import re
import threading
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import ann, bpe, components, embed_dedup, langid, license_scan, lm_score, mixing, near_dup, queries, token_counts, toxicity
from veilspark.llm.pieces import take_ranges
from veilspark.llm.words import slices

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, draw int"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1) for r in rows], SCHEMA)


EDGE = [
    (1, "The quick brown fox, it's 42!", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "   \n\t ", "de", "a"), (5, "word " * 3000, "en", "a"), (5, "word " * 3000, "en", "a"),
    (None, "no key here", "en", "b"), (6, "日本語 ünïcödé <|endoftext|> x\x1c y", "fr", None), (7, "a" * 1500 + "!" * 900, "en", "c"),
]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(RANKS, P.PATTERN)


def test_bpe_equals_library_and_round_trips(spark, tik):
    docs = documents(spark, EDGE)
    out = bpe.encode_documents(docs, RANKS, P.PATTERN)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    want = []
    for i, text, *_ in EDGE:
        ids = tik.encode_ordinary(text or "")
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(out, RANKS, P.PATTERN).collect()}
    assert back[6] == EDGE[7][1] and back[2] == ""
    assert bpe.encode_documents(docs.limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(tik, encoder, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = encoder.encode([text])[0]
    assert ids.tolist() == tik.encode_ordinary(text) and encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "eéñ日"])
def test_bpe_of_long_pieces(encoder, tik, letters):
    rng = random.Random(5)
    for n in (bpe.WIDE + 1, 3000, 20_000):
        text = "".join(rng.choices(letters, k=n))
        assert encoder.encode([text])[0].tolist() == tik.encode_ordinary(text)
    long = "".join(rng.choices(letters, k=300_000))  # no quadratic work
    assert encoder.decode(encoder.encode([long])[0]) == long.encode()


def test_bpe_memory_of_pieces_is_bounded(encoder, tik, monkeypatch):
    monkeypatch.setattr("veilspark.llm.pieces.REMEMBERED", 50)
    rng = random.Random(4)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcdef", k=rng.randint(1, 7))) for _ in range(40)) for _ in range(3)]
        assert [x.tolist() for x in encoder.encode(texts)] == [tik.encode_ordinary(x) for x in texts]
        assert len(encoder.pieces.numbers) <= 50 + 130


def test_take_ranges():
    assert take_ranges(np.arange(10), np.array([7, 0]), np.array([2, 3])).tolist() == [7, 8, 0, 1, 2]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(spark, tmp_path, name):
    docs, cache = documents(spark, EDGE), f"file://{tmp_path}/cache"
    rows = lambda df: sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in df.collect())
    got = rows(token_counts.count_tokens(docs, P.path(name), cache))
    if name.endswith("model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(P.path(name))
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    assert got == sorted((i or 0, len((t or "").encode()), count(t or "")) for i, t, *_ in EDGE)
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == len({t or "" for _, t, *_ in EDGE})
    assert rows(token_counts.count_tokens(docs, P.path(name), cache)) == got
    assert token_counts.read_cache(spark, cache).count() == stored.count()  # all hits: nothing is appended


def brute_licenses(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    gpl, bsd = license_scan.TEMPLATES["gpl"][0][0], license_scan.TEMPLATES["bsd"][0][0]
    texts = [r[1] for r in EDGE] + ["CC BY-NC 4.0 cc by apache, LICENSE gnu general public GNU General Public License; mit", "x " + gpl + " y", gpl.replace("redistribute", "share"), "MIT license mit MIT License éÉ", bsd]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    for i, text in enumerate(texts):
        r = found[i]
        starts = [x["first_word"] for x in r["base"]]
        assert (r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x["label"] for x in r["base"]}))) == brute_licenses(text)
    share = lambda i, label: max((x["share"] for x in found[i]["spans"] if x["label"] == label), default=0)
    n = len(EDGE)
    assert share(n + 1, "gpl") == 1.0 and 0.9 < share(n + 2, "gpl") < 1 and share(n + 4, "bsd") == 1.0 and share(0, "gpl") == 0


def named(text):
    automaton = license_scan._automaton()
    return {x[0] for x in automaton.spans(automaton.scan(text)[2]) if x[-1]}


@pytest.mark.parametrize(("text", "labels"), [
    ("The film was released under the title Night Train in 1962", set()),
    ("Released under the Apache License 2.0", set()),  # the base phrase alone
    ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", {"cc-by-sa"}),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by"}),
    ("as is basis without warranties or conditions of any kind either express or implied", set()),
    ("you can redistribute it and or modify it under the terms of our house rules as published by the club, either version 3 of the rules or any later version", set()),
    ("the above copyright notice and this permission notice must be kept", set()),
    ("Anyone may copy, modify, publish, use or sell this, either in source code form or as a compiled binary, for any purpose and by any means.", set()),
])
def test_labels_need_a_telling_phrase(text, labels):
    assert named(text) == labels


@pytest.mark.parametrize("label", sorted(license_scan.TEMPLATES))
def test_whole_licences_have_their_own_label_alone(label):
    rng = random.Random(3)
    for text, _ in license_scan.TEMPLATES[label]:
        assert named("before it " + text + " after") == {label}
        words = text.split()
        if len(words) > 60:  # a word in forty changed
            assert named(" ".join("edited" if rng.random() < 0.025 else w for w in words)) == {label}


def brute_chain(found, telling, gap):
    """(told, words) of the best chain of one template's matches, over all sequences of them."""
    found, best = sorted(set(found)), (False, 0)

    def go(last, words, told):
        nonlocal best
        best = max(best, (told, words))
        for m in found:
            at, i, n = m
            over = max(0, last[0] + last[2] - at, last[1] + last[2] - i)
            if (i, at) > (last[1], last[0]) and i <= last[1] + last[2] + gap and at <= last[0] + last[2] + gap and over < n and at + n > last[0] + last[2] and i + n > last[1] + last[2]:
                go(m, words + n - over, told or any(at <= a and b < at + n for a, b in telling))

    for at, i, n in found:
        go((at, i, n), n, any(at <= a and b < at + n for a, b in telling))
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=16), st.lists(st.sampled_from("abcd"), min_size=4, max_size=12), st.integers(0, 8))
def test_chains(text, template, tell):
    phrase = " ".join(template[tell : tell + 2]) or template[0]
    automaton = license_scan.LicenseAutomaton({"t": [(" ".join(template), (phrase,))]}, {})
    # every maximal match: the longest piece of the template that ends at a word and does not go on
    longest = [max((k for k in range(i + 2) if any(template[j : j + k] == text[i + 1 - k : i + 1] for j in range(len(template)))), default=0) for i in range(len(text))]
    ends = [i for i, n in enumerate(longest) if n >= license_scan.LONG and (i + 1 == len(text) or longest[i + 1] <= n)]
    want = {(0, j, i - longest[i] + 1, longest[i]) for i in ends for j in range(len(template)) if template[j : j + longest[i]] == text[i + 1 - longest[i] : i + 1]}
    found = automaton.scan(" ".join(text))[2]
    assert set(found) == want
    got = automaton.spans(found)
    told, words = brute_chain([x[1:] for x in want], automaton.telling[0], license_scan.GAP)
    assert [(x[3], x[5]) for x in got] == ([(words, told and words >= min(license_scan.ENOUGH, license_scan.SHARE * len(template)))] if want else [])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), min_size=1, max_size=4))
def test_matching_statistics(text, templates):
    automaton = license_scan.LicenseAutomaton({"t": [(" ".join(t), ()) for t in templates]}, {})
    subs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    codes = [automaton.vocabulary[w.encode()] for w in text]
    got = [n for _, n in automaton.statistics(codes)]
    assert got == [max((k for k in range(1, i + 2) if tuple(text[i - k + 1 : i + 1]) in subs), default=0) for i in range(len(text))]


def brute_phrases(sample, text):
    """Greedy longest phrases of the whole text."""
    count = i = 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        count += 1
        i += max(1, n)
    return count


@pytest.mark.parametrize("stretch", [7, 64, 1024])
def test_cross_parsing(monkeypatch, stretch):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    rng = random.Random(2)
    samples = {"x": ["".join(rng.choices("abc d", k=400)), "aaaaa"], "y": ["".join(rng.choices("abe", k=300))]}
    parser = langid.train(samples)
    table = parser.classes()
    words = lambda t: "".join(" " if c == 0 else chr(int(c) + 96) for c in langid.symbols(t, table))
    texts = ["".join(rng.choices("abcde f", k=n)) for n in (1, 30, 1500, 3000)] + ["", "a" * 2500, "ab" * 900, "zz!z"]
    got, lengths, letters = langid.phrases(parser, table, texts)
    for i, text in enumerate(texts):
        clean = words(text)
        assert lengths[i] == len(clean) and letters[i] == any(map(str.isalpha, text))
        for j, lang in enumerate(parser.langs):
            assert got[j][i] == brute_phrases("".join(words(s) + " " for s in samples[lang]), clean)


def test_slices_of_a_batch():
    texts = ["ab", None, "", "é" * 40, "x", "y" * 9, "z"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["cut", *texts], pa.string())}).slice(1)
    for limit in (1, 10, 1000):
        got = list(slices(batch, limit))
        assert [t for _, _, part in got for t in part] == [x or "" for x in texts]
        assert [lo for lo, _, _ in got] == [0, *[hi for _, hi, _ in got]][:-1] and got[-1][1] == len(texts)
        assert all(len("".join(part[:-1]).encode()) < limit for _, _, part in got)
    assert list(slices(batch.slice(0, 0), 10)) == []


def test_language_memory_does_not_grow_with_the_batch():
    rng = random.Random(8)
    parser = langid.train({name: [" ".join("".join(rng.choices(letters, k=5)) for _ in range(60))] for name, letters in (("a", "abcd"), ("b", "efgh"), ("c", "ijkl"), ("d", "mnop"))})
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(5000))
    batch = pa.RecordBatch.from_pydict({"text": pa.array([text] * 100)})
    run = langid._determined(SimpleNamespace(value=parser), "text", 100.0)
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in run(iter([batch]))) == 100
        assert tracemalloc.get_traced_memory()[1] < 120_000_000
    finally:
        tracemalloc.stop()


def test_language_models_of_large_alphabets_stay_small():
    rng = random.Random(4)
    chinese = ["".join(chr(rng.randrange(0x4E00, 0x4E00 + 3000)) for _ in range(2000)) for _ in range(32)]
    english = [" ".join(rng.choices("the of and that with this".split(), k=400)) for _ in range(32)]
    parser = langid.train({"zh": chinese, "en": english})
    assert parser.goto.nbytes + parser.first.nbytes < 50_000_000
    assert parser.langs[langid.predictions(parser, parser.classes(), [chinese[0][:300]])[0][0]] == "zh"


def test_every_language_is_learned(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices(f"abc{chr(0x4E00 + i % 80)}", k=5)) for _ in range(30)), f"l{i % 80}", "s") for i in range(400)]
    assert len(langid.fit(documents(spark, rows)).langs) == 80


def test_language_id(spark):
    rng = random.Random(1)
    vocabulary = {"en": "the of and that with this".split(), "de": "der die und nicht ist ein".split()}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=60)), lang, "s") for i in range(80) for lang in [("en", "de")[i % 2]]]
    docs = documents(spark, rows + [(900, None, "en", "s"), (901, "!!! 12", "de", "s"), (902, "日本", None, "s")])
    out = {r["doc_id"]: r for r in langid.identify(docs, queries.language_model(docs)).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang, _ in rows)
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[902]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.drop_undetermined(docs, queries.language_model(docs)).count() == 81
    odd = documents(spark, [(1, rows[0][1], "en", "s"), (2, "qzxkw jvpqy zzxqj kkqvw " * 10, "en", "s"), (3, "short qzx", "en", "s"), (4, "", "en", "s")])
    assert sorted(r["doc_id"] for r in langid.drop_undetermined(odd, queries.language_model(docs)).collect()) == [1, 3]
    assert langid.drop_undetermined(docs, langid.fit(docs.limit(0))).count() == 81  # nothing learned: all with letters stay
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_toxicity(spark, tmp_path):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=40)
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["awful", "nasty"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    docs = documents(spark, rows + [(900, None, "en", "s"), (901, "", "en", "s")])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = queries.toxicity_model(spark, docs, str(tmp_path))
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((out[i] >= 0.3) == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert 0 <= out[900] == out[901] < 0.5
    assert toxicity.drop_toxic(docs, model, 0.3).count() == sum(s < 0.3 for s in out.values())
    few = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, toxic int"), "toxic", positives=1000, negatives=120)
    sampled = {r["doc_id"]: r["score"] for r in toxicity.score(docs, few).collect()}  # one class sampled, the other whole
    assert sum((sampled[i] >= 0.3) == (i % 4 == 0) for i in range(400)) / 400 > 0.97
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), "toxic")
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(1000, None, "en", "b"), (5, "x y", "en", "a")]
    docs = documents(spark, rows)
    size, quality = queries.mix_columns()
    out = mixing.mix(docs, size, quality).select("row.doc_id", "size", "source_size", "target", "times", "taken").collect()
    assert len(out) == len(rows) and all(r["taken"] == r["times"] * r["size"] <= 2 * r["size"] for r in out)
    total = Counter()
    for _, text, _, source in rows:
        total[source] += len((text or "").split())
    order = sorted([s for s in total if s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * total[s], mid * weight[s]) for s in total) < 1.5 * sum(total.values()) else (low, mid)
    source = {(i, len((t or "").split())): s for i, t, _, s in rows}
    taken, target = Counter(), {}
    for r in out:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["source_size"] == total[s]
    assert all(math.isclose(target[s], min(2 * total[s], high * weight[s]), rel_tol=1e-6) and abs(taken[s] - target[s]) <= 31 for s in total)
    again = mixing.repeated(docs, size, quality)
    assert again.columns == docs.columns and again.count() == sum(r["times"] for r in out)
    assert mixing.mix(docs.limit(0), size, quality).count() == 0


def test_mix_of_null_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 50)  # groups of equal rows in several stretches
    rows = [(None, "w " * 10, "en", "abc"[i % 3]) for i in range(600)] + [(7, "x y z", "en", "a")] * 100
    docs = documents(spark, rows)
    size, quality = queries.mix_columns()
    for df in (mixing.mix(docs, size, quality).select("row.doc_id", "size", "target", "source_size", "taken"), mixing.mix(docs, size, quality, carry=("source",)).select("row.doc_id", "size", "target", "source_size", "taken")):
        out = df.collect()
        by = {}
        for r in out:
            by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
        assert len(out) == 700 and all(abs(sum(taken) - target) <= 10 for (_, target), taken in by.items())
    again = mixing.repeated(docs, size, quality)
    assert again.count() == sum(r["taken"] // r["size"] for r in out)


def test_mix_cuts_follow_the_draws(spark):
    rows = documents(spark, [(i, "w " * 10, "en", "abc"[i % 3]) for i in range(900)]).select(F.col("source"), F.lit(10).cast("long").alias("size"), mixing.draw(F.lit(1.0), "s", F.col("doc_id")).alias("draw"))
    goal = spark.createDataFrame([("a", 3000, 1234.0), ("b", 3000, 3777.0), ("c", 3000, 0.0)], "source string, source_size long, target double")
    draws = {s: sorted(r["draw"] for r in rows.collect() if r["source"] == s) for s in "abc"}
    for r in mixing.cuts(rows, goal).collect():
        budget = r["target"] - r["epochs"] * 3000
        chosen = [d for d in draws[r["source"]] if (p := min(mixing.PLACES - 1, int(d / (1 + d) * mixing.PLACES))) < r["place"] or (p == r["place"] and r["cut"] is not None and d <= r["cut"])]
        assert len(chosen) == round(budget / 10 + 1e-9) and chosen == draws[r["source"]][: len(chosen)]


def brute_scores(texts, order, alpha=0.4):
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    count = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [count(w) for w in words]
    everything = sum(own, Counter())
    total = sum(map(len, words))
    out = []
    for w, mine in zip(words, own, strict=True):
        rest = lambda gram: everything[gram] - mine[gram]  # noqa: E731, B023
        log = 0.0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if rest(gram):
                    log += math.log(rest(gram) / (rest(gram[:-1]) if n > 1 else max(1, total - len(w))))
                    break
                log += math.log(alpha)
            else:
                log -= math.log(max(1, total - len(w)))
        out.append((len(w), log))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(spark, order):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("a b c d e f g".split(), k=rng.randint(0, 25))) for _ in range(60)] + [None, "", "unique words only", "A b, A b!", "A b, A b!", "a b c " * 4000]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in lm_score.score(docs, order=order).collect()}
    assert len(got) == len(texts)
    for i, (n, log) in enumerate(brute_scores(texts, order)):
        assert got[i]["n_words"] == n and math.isclose(got[i]["log_score"], log, rel_tol=1e-9, abs_tol=1e-9)
        assert (got[i]["mean_log_score"] is None) == (n == 0)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("unit", [3, 40])
def test_lm_scores_of_frequent_words_cut_into_units(spark, order, unit):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a b c d e f g".split(), weights=[9, 5, 3, 2, 1, 1, 1], k=rng.randint(0, 25))) for _ in range(60)] + ["a", "a a a a", "a b " * 50, "only here a", "", None]
    docs = documents(spark, [(i % 50, t, "en", "s") for i, t in enumerate(texts)])
    got = sorted((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in lm_score.score(docs, order=order, unit=unit).collect())
    assert got == sorted((i % 50, n, round(log, 6)) for i, (n, log) in enumerate(brute_scores(texts, order)))


def test_lm_scores_keep_little_on_disk(spark, tmp_path):
    rng = random.Random(5)
    at = tmp_path / "documents"
    documents(spark, [(i, " ".join(rng.choices([f"w{k}" for k in range(20_000)], k=400)), "en", "s") for i in range(2000)]).repartition(2).write.parquet(str(at))
    folders = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))

    def used():
        out = 0
        for f in (f for d in folders for f in d.rglob("*")):
            with contextlib.suppress(OSError):  # a file may go meanwhile
                out += f.stat().st_size if f.is_file() else 0
        return out

    most, over, floor = [0], threading.Event(), used()

    def watch():
        while not over.wait(0.05):
            most.append(used() - floor)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = lm_score.score(spark.read.parquet(str(at)))
        assert got.count() == 2000
    finally:
        over.set()
        watcher.join()
    assert max(most) < 4 * sum(f.stat().st_size for f in at.glob("*.parquet"))


def test_lm_scores_keep_every_row(spark):
    docs = documents(spark, EDGE)
    got = lm_score.score(docs)
    assert got.columns == ["doc_id", "n_words", "log_score", "mean_log_score"]
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == sorted(r[0] or 0 for r in EDGE)
    assert lm_score.score(docs.limit(0)).count() == 0


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 9))
def test_banded_edit_distance(a, b, most):
    assert near_dup.edit_distance(a, b, most) == min(brute_edit(a, b), most + 1)


def test_near_duplicates(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, group = [], {}
    for g in range(25):
        base = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                copy[rng.randrange(len(copy))] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy), "en", "s"))
    passage = [word() for _ in range(60)]
    for _ in range(12):  # a shared passage alone makes no duplicates
        group[len(rows)] = f"p{len(rows)}"
        rows.append((len(rows), " ".join([*(word() for _ in range(80)), *passage]), "en", "s"))
    extra = [(500, None, "en", "s"), (501, "", "en", "s"), (502, "!!", "en", "s"), (503, "hi", "en", "s"), (504, "Hi!", "en", "s"), (None, "hi", "en", "s")]
    got = near_dup.near_duplicates(documents(spark, rows + extra)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    tokens = {i: re.findall(r"\w+", t) for i, t, *_ in rows}
    links = [(a, b) for a in tokens for b in tokens if a < b and group[a] == group[b] and 1 - brute_edit(tokens[a], tokens[b]) / max(len(tokens[a]), len(tokens[b])) >= 0.8]
    least = {i: i for i in tokens}
    for _ in tokens:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert {i: by[i]["class_id"] for i in tokens} == least
    assert by[504]["class_id"] == 503 and not by[504]["kept"] and by[500]["kept"] and by[501]["class_id"] == 501 and by[502]["kept"] and by[None]["class_id"] is None
    kept = near_dup.drop_near_duplicates(documents(spark, rows + extra))
    assert kept.count() == len(set(least.values())) + 5 and kept.columns[0] == "doc_id"
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


def brute_kept(rows, similarity=0.8):
    """The class of each row, by all pairs of distinct word sequences."""
    words = {t: tuple(re.findall(r"\w+", (t or "").lower())) for _, t in rows}
    nodes = sorted({w for w in words.values() if w})
    of = {w: w for w in nodes}
    links = [(a, b) for a in nodes for b in nodes if a < b and 1 - brute_edit(a, b) / max(len(a), len(b)) >= similarity]
    for _ in nodes:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    least = {}
    for k, t in rows:
        if k is not None and words[t]:
            c = of[words[t]]
            least[c] = min(k, least.get(c, k))
    return [k if k is None or not words[t] else least[of[words[t]]] for k, t in rows]


def test_keys_with_several_texts_lose_none(spark):
    rng = random.Random(21)
    text = lambda n=60: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    x, d, e, f = text(), text(), text(), text()
    near = d.split()
    for i in range(0, 50, 10):
        near[i] = "changed"
    near = " ".join(near)
    rows = [(1, x), (5, x), (5, d), (7, d), (9, near), (11, e), (11, e), (12, e), (12, f), (3, f), (None, f), (20, ""), (20, None), (21, "!"), (13, f)]
    docs = documents(spark, [(*r, "en", "s") for r in rows])
    got = near_dup.near_duplicates(docs)
    classes = brute_kept(rows)
    order = lambda v: sorted(v, key=str)
    assert order((r["doc_id"], r["class_id"], r["kept"]) for r in got.collect()) == order((k, c, c == k) for (k, _), c in zip(rows, classes, strict=True))
    kept = [(r["doc_id"], r["text"]) for r in near_dup.drop_near_duplicates(docs).collect()]
    want = {(k, t or "") for (k, t), c in zip(rows, classes, strict=True) if k is not None and c == k} | {(None, f)}
    assert order((k, t or "") for k, t in kept) == order(want) and sum(t == d for _, t in kept) == 1 and (5, d) in kept


def test_random_keys_and_texts_against_all_pairs(spark, monkeypatch):
    rng = random.Random(22)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    pool = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 60))]
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.choice([0, 1, 2, 15])):
                copy[at] = word()
            pool.append(" ".join(copy))
    rows = [(rng.randrange(40), rng.choice(pool)) for _ in range(120)]
    docs = documents(spark, [(*r, "en", "s") for r in rows])
    classes = brute_kept(rows)
    kept = sorted({(k, t) for (k, t), c in zip(rows, classes, strict=True) if c == k})
    assert sorted((r["doc_id"], r["text"]) for r in near_dup.drop_near_duplicates(docs).collect()) == kept
    monkeypatch.setattr(near_dup, "BROADCAST_NODES", 0)  # the same by shuffled joins
    assert sorted((r["doc_id"], r["text"]) for r in near_dup.drop_near_duplicates(docs).collect()) == kept


def test_near_duplicates_whose_values_lie_in_a_hot_bucket(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, rows = [word() for _ in range(70)], []
    for g in range(100):  # pairs of one group share no k-mer of their own words
        own = [word() for _ in range(30)]
        for c in range(2):
            copy = [word() if c and i % 2 else w for i, w in enumerate(own)]
            rows.append((2 * g + c, " ".join([*copy, *passage]), "en", "s"))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(documents(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(200)}


@pytest.mark.parametrize("block", [500_000, 40_000])
def test_large_buckets_are_decided_whole(spark, monkeypatch, block):
    """A passage and own words that many texts hold: similar texts share no rare word, and all finer buckets are large."""
    monkeypatch.setattr(near_dup, "BLOCK_WORDS", block)
    rng = np.random.default_rng(17)
    own = rng.integers(0, 9, (640, 30))
    texts = [" ".join([*(f"w{i}x{w}" for i, w in enumerate(t)), *(f"passage{i}" for i in range(70))]) for t in own]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    differ = (own[:, None] != own[None]).sum(2)  # a word belongs to its place, so this is the edit distance
    least = np.arange(640)
    while True:
        new = np.where(differ <= 20, least[None], 640).min(1)
        if (new == least).all():
            break
        least = new
    assert 100 < len(set(least.tolist())) < 600 and got == dict(enumerate(least.tolist()))


@pytest.mark.parametrize("shared", [0.3, 0.6])
def test_finer_values_of_similar_texts(shared):
    """Texts that share a frequent passage: those that are similar by their own words too share a finer value, others seldom."""
    rng = random.Random(31)
    word = lambda: str(rng.randrange(10**9))
    passage, texts = [word() for _ in range(int(100 * shared))], []
    for _ in range(300):
        own = [word() for _ in range(100 - len(passage))]
        copy = list(own)
        for at in rng.sample(range(len(own)), 20):
            copy[at] = word()
        texts += [" ".join(own + passage), " ".join(copy + passage)]
    often = np.zeros(near_dup.RARITY_SLOTS, np.int64)
    with np.errstate(over="ignore"):
        h, counts = near_dup.word_hashes(texts)
        np.add.at(often, (near_dup.kmers(h, counts, 1)[0] % np.uint64(near_dup.RARITY_SLOTS)).astype(np.int64), 1)
        values, text = near_dup.finer(h, counts, often, near_dup.K)
    held = [set() for _ in texts]
    for v, t in zip(values.tolist(), text.tolist(), strict=True):
        held[t].add(v)
    assert np.mean([bool(held[i] & held[i + 1]) for i in range(0, 600, 2)]) >= 0.99
    rare = [set(values[(text == t)][: near_dup.FINER].tolist()) for t in range(0, 600, 2)]
    assert np.mean([bool(rare[i] & rare[i + 1]) for i in range(299)]) < 0.05


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 2), st.integers(0, 9)), max_size=10), st.sampled_from([0.6, 0.8, 0.9]))
def test_bags_keep_all_similar_texts(a, edits, similarity):
    b = list(a)
    for at, how, w in edits:
        at = min(at, len(b))
        b[at : at + (how > 0)] = [w] if how < 2 else []
    words = [near_dup.word_hashes([" ".join(f"w{x}" for x in t)])[0].astype("<u4").tobytes() for t in (a, b)]
    bags = pa.Table.from_batches(near_dup._bags([pa.RecordBatch.from_pydict({"id": pa.array([1, 2]), "words": pa.array(words)})])).to_pydict()
    pair = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "ba": [bags["bag"][0]], "bb": [bags["bag"][1]], "na": [len(a)], "nb": [len(b)]})
    kept = sum(x.num_rows for x in near_dup._sifted(similarity)([pair]))
    assert kept == 1 or not near_dup.similar(np.array(a), np.array(b), similarity)


def test_numbers_of_digests_never_meet(spark, monkeypatch):
    plain = F.xxhash64
    monkeypatch.setattr(near_dup.F, "xxhash64", lambda *c: F.pmod(plain(*c), F.lit(50)) if len(c) == 1 else plain(*c))  # most numbers meet
    firsts = spark.createDataFrame([(bytes([i]), i) for i in range(100)], "node binary, doc long")
    numbered, renamed = near_dup._numbered(firsts)
    rows = numbered.collect()
    assert len(rows) == len({r["id"] for r in rows}) == 100 and {r["node"]: r["id"] for r in near_dup._with_ids(firsts, renamed).collect()} == {r["node"]: r["id"] for r in rows}


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_sketches_of_texts_with_spread_edits(similarity):
    rng, texts = random.Random(1), []
    for _ in range(600):
        a = [str(rng.randrange(10**9)) for _ in range(rng.randint(50, 300))]
        b = list(a)
        for at in rng.sample(range(len(a)), int((1 - similarity) * len(a) + 1e-9)):
            b[at] = str(rng.randrange(10**9))
        texts += [" ".join(a), " ".join(b)]
    with np.errstate(over="ignore"):
        key, n = near_dup.kmers(*near_dup.word_hashes(texts))
        sketch = near_dup.sketches(key, n)
    assert (sketch[::2] == sketch[1::2]).any(1).mean() >= 0.95


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    least = {i: i for a, b in links if a is not None and a != b for i in (a, b)}
    for _ in range(70):
        for a, b in links:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == least
    halves = [spark.createDataFrame(links[i::2], "a long, b long") for i in (0, 1)]
    assert {r["node"]: r["component"] for r in components.extended(components.components(halves[0]), halves[1]).collect()} == least


def plain_ftrl(rows, labels, epochs, alpha, beta, l1, l2, bits):
    """FTRL-proximal, one coordinate after another in plain numbers."""
    z, n = Counter(), Counter()

    def weight(j):
        penalty = 0.0 if j == 1 << bits else l1
        if abs(z[j]) <= penalty:
            return 0.0
        return -(z[j] - math.copysign(penalty, z[j])) / ((beta + math.sqrt(n[j])) / alpha + (0.0 if j == 1 << bits else l2))

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            w = {j: weight(j) for j in row}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for j in row:
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha * w[j]
                n[j] += g * g
    return {j: w for j in n if (w := weight(j))}


@pytest.mark.parametrize(("l1", "l2"), [(0.5, 0.0), (0.0, 0.3), (2.0, 0.1)])
def test_ftrl_equals_a_plain_loop(l1, l2):
    rng = np.random.default_rng(int(10 * l1))
    bits = 6
    rows = [np.append(rng.choice(60, rng.integers(0, 12), replace=False), 1 << bits).astype(np.uint32) for _ in range(150)]
    labels = np.array([int(1 in r or rng.random() < 0.2) for r in rows])
    model = toxicity.ftrl(rows, labels, bits, 3, 0.4, 1.0, l1, l2)
    want = plain_ftrl([r.tolist() for r in rows], labels.tolist(), 3, 0.4, 1.0, l1, l2, bits)
    bias = want.pop(1 << bits)
    assert model.index.tolist() == sorted(want) and np.allclose(model.weight, [want[j] for j in sorted(want)], rtol=1e-9) and math.isclose(model.bias, bias, rel_tol=1e-9)
    assert not l1 or len(want) < 60  # a penalty leaves weights at 0


def test_toxicity_features_are_word_pairs_and_skips():
    """Equal features exactly where words, neighbours or words around one are equal, whatever text they are in."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 9))) for _ in range(40)]
    of, at = toxicity.features(texts, 40)
    got = [sorted(at[of == i].tolist()) for i in range(len(texts))]
    name = {}
    for i, t in enumerate(texts):
        w = t.split()
        plain = [(x,) for x in w] + [(0, *p) for p in zip(w, w[1:])] + [(1, x, y) for x, y in zip(w, w[2:])]
        assert len(got[i]) == len(plain)
        name[i] = Counter(plain)
    for i in range(len(texts)):
        for j in range(i):
            assert (name[i] == name[j]) == (got[i] == got[j]) and sum((name[i] & name[j]).values()) == sum((Counter(got[i]) & Counter(got[j])).values())


def vectors(spark, x, labels=None, extra=()):
    rows = [(i, [float(v) for v in r], None if labels is None else labels[i], "z") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")


BAD = [(900, None, 1, "z"), (901, [0.0] * 16, 1, "z"), (902, [float("nan")] + [1.0] * 15, 1, "z"), (903, [float("inf")] + [1.0] * 15, 1, "z"), (904, [None] + [1.0] * 15, 1, "z"), (905, [1.0] * 3, 1, "z")]


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:140] = x[20]  # ties
    got = {}
    for r in ann.search(vectors(spark, x, extra=BAD), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    d, hit = x.astype(float), 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert all(math.isclose(s, float(d[q] @ d[i]), rel_tol=1e-12) for _, i, s in rows)
        s = d @ d[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(700), -s))[:20].tolist()) & {r[1] for r in rows})
    assert hit / (35 * 20) >= 0.9
    few = ann.search(vectors(spark, x[:5], extra=BAD), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert ann.search(vectors(spark, x[:0]), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_of_repeated_and_null_keys(spark):
    a, b, c, d = ([float(v) for v in np.eye(4)[i] + 0.1 * i] for i in range(4))
    rows = [(1, a, 0, "x"), (1, b, 0, "x"), (20, c, 0, "ask"), (20, d, 0, "x"), (3, a, 0, "x"), (None, d, 0, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")
    score = lambda x, y: float(np.dot(np.float32(x).astype(float), np.float32(y).astype(float)))
    got = ann.search(table, F.col("cell") == "ask").orderBy("rank").collect()
    want = sorted(((-score(c, v), k is not None, k or 0, k) for k, v, *_ in [rows[0], rows[1], rows[3], rows[4], rows[5]]))
    assert [(r["vec_id"], round(r["score"], 6)) for r in got] == [(k, round(-s, 6)) for s, _, _, k in want] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    both = ann.search(table, F.col("vec_id") % 20 == 0)
    assert both.count() == 10 and both.where("vec_id = 20").count() == 2  # each row of the key is the other's candidate


def test_embedding_duplicates_of_repeated_and_null_keys(spark):
    a, b, c = ([float(v) for v in np.eye(4)[i]] for i in range(3))
    rows = [(5, a, 1, "x"), (5, b, 1, "x"), (7, a, 1, "x"), (None, a, 1, "x"), (None, c, 1, "x"), (9, b, 2, "x"), (None, None, 1, "x"), (8, b, 1, "x"), (8, b, 1, "x")]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string"))
    order = lambda v: sorted(v, key=str)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(5, 2, 5, True), (7, 2, 5, False), (None, 2, 5, False), (None, 0, None, True), (9, 0, 9, True), (None, 0, None, True), (5, 2, 5, True), (8, 2, 5, False), (8, 2, 5, False)]
    assert order(map(tuple, got.collect())) == order(want)


def test_ann_among_near_copies_and_in_small_cells(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 16))
    x[::2] = x[0] + 1e-3 * rng.normal(size=(600, 16))  # a hot group whose rows share codes
    x = x.astype(np.float32)
    d, got = x.astype(float), {}
    for r in ann.search(vectors(spark, x), F.col("vec_id") % 40 == 0, rerank=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 1200, 40):
        s = d @ d[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(1200), -s))[:20].tolist()) & got[q])
    assert hit / (30 * 20) >= 0.95
    few = ann.search(vectors(spark, rng.normal(size=(300, 16))), F.col("vec_id") % 20 == 0, recall=0.01).groupBy("query_id").count().collect()
    assert len(few) == 15 and {r["count"] for r in few} == {20}


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 16))
    for i in range(100, 400):
        x[i] = x[i % 7] + rng.normal(size=16) * 0.25
    x = x.astype(np.float32)
    labels = [None if i % 50 == 0 else i % 3 for i in range(500)]
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors(spark, x, labels, BAD), shard_rows=60).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    same = np.array([[a == b and a is not None for b in labels] for a in labels])
    near = (u @ u.T >= 0.93) & same & ~np.eye(500, dtype=bool)
    least = np.arange(500)
    for _ in range(50):
        least = np.minimum(least, np.where(near, least[None, :], 500).min(1))
    assert len(got) == 506 and all(got[i]["n_links"] == near[i].sum() and got[i]["component_id"] == least[i] and got[i]["kept"] == (least[i] == i) for i in range(500))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))
    assert embed_dedup.near_duplicates(vectors(spark, x[:0], [])).count() == 0


def test_walks_find_what_brute_force_finds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    world = embed_dedup.SmallWorld.build(x)
    ids, _ = world.search(x.astype(np.float32)[:200], 64)
    assert (ids == np.arange(200)[:, None]).any(1).mean() > 0.95
    truth = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(truth.tolist(), ids.tolist())]) > 0.85
