"""Wrapper extraction, the filter audit and fill-in-middle against brute force and SQL, with nulls, empty, repeated and odd rows."""

import hashlib
import html
import itertools
import random
import re

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import filter_audit, fim, html_extract, html_wrapper, queries
from veilspark.llm.html_tree import parse

SF = "/root/testdata/sf0.001"


# --- pages


def plain(page):
    """The article of a page that has one, by patterns."""
    page = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", page)
    found = re.search(r"(?s)<article[^>]*>(.*?)</article>", page)
    blocks = re.split(r"</?(?:p|h1)[^>]*>", found[1] if found else "")
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_every_page_of_the_table(spark):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op11_html_extract(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert got == {r["page_id"]: (plain(r["html"]), len(plain(r["html"]))) for r in pages}


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def sentence(rng, n=12):
    return " ".join(rng.choices(WORDS, k=n))


def bare_page(rng, k):
    """A page without article or main: notice, menu of links, unnamed blocks of text, a table, comments."""
    blocks = [sentence(rng, 15) for _ in range(rng.randint(2, 6))]
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, 4))
    extra = f"<div class='promo-box'>{sentence(rng)}</div>" if k % 2 else ""
    page = (
        f"<html><head><title>{sentence(rng)}</title></head><body><div>Subscribers read this first &amp; last</div><ul>{menu}</ul>{extra}"
        f"<div class=x{k}>" + "".join(f"<p>{b}" for b in blocks) + "</div>"
        f"<section id='comments'><p>{sentence(rng)}</p></section><div>Printed by the host</div></body></html>"
    )
    return page, "\n".join(blocks)


def test_wrappers_find_what_changes_between_pages(spark):
    rng = random.Random(1)
    made = [bare_page(rng, k) for k in range(40)]
    rows = [(k, f"http://Plain.example/{k}", page, "clash", k) for k, (page, _) in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == {k: want for k, (_, want) in enumerate(made)}


def test_levels_of_merging_and_both_joins_agree(spark, monkeypatch):
    rng = random.Random(2)
    made = [bare_page(rng, k) for k in range(60)]
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.example/", page) for k, (page, _) in enumerate(made)], "page_id long, url string, html string").repartition(12)
    want = {k: text for k, (_, text) in enumerate(made)}
    monkeypatch.setattr(html_extract, "FAN", 2)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == want
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html_extract, "ROWS", 7)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == want


def test_odd_pages(spark):
    rows = [
        (1, "http://a.example/1", None), (2, "http://a.example/2", ""), (3, None, "<p>no host"), (None, "nonsense", "just text &lt;here&gt; a < b"), (4, "http://a.example/4", "<article>one<p>two</article>"),
        (4, "http://a.example/4", "<article>one<p>two</article>"), (5, "http://b.example", "<main><h1>T</h1><aside>x</aside><p>body&nbsp;text\n more<br>line</p><div class='share-buttons'>s</div></main><footer>f</footer>"),
        (6, "http://b.example", "<" * 50 + "div" * 3 + '<p class="a' + "b" * 2000), (7, "http://c.example", "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after"),
        (8, "http://d.example", "<article><header><h1>Head</h1></header><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><form>f</form></article><article class=comment>no</article>"),
        (9, "http://e.example", "<article>" + "<h2>s</h2><pre>p</pre><p>q</p>" * 500 + "</article>"),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, wrapper int")
    out = html_extract.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0), r["text"]) for r in out.collect())
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] == by[2] == "" and by[3] == "no host" and by[0] == "just text <here> a < b" and by[4] == "one\ntwo" and sum(k == 4 for k, _ in got) == 2
    assert by[5] == "T\nbody text more line" and by[7] == "deep\nafter" and by[8] == "Head\na b\nc\nx\ny" and by[9] == "\n".join(["s", "p", "q"] * 500)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_wrapper_of_groups_options_and_constants():
    def page(text, n):
        return html_wrapper.of_page(parse(text), n)

    a = page("<dl><dt>a<dd>1<dt>b<dd>2</dl><p>same</p>", 1)
    b = page("<dl><dt>c<dd>3</dl><h2>new</h2><p>same</p>", 2)
    both = html_wrapper.merged(a, b)
    dl, h2, p = both[2]
    assert dl[2][0][0] == "(" and dl[2][0][1] == html_wrapper.REPEATED and [n[0] for n in dl[2][0][2]] == ["dt", "dd"]
    assert h2[1] == html_wrapper.OPTIONAL and p[2][0][2] == html_wrapper.digest("same") and dl[2][0][2][0][2][0][2] is None
    assert html_wrapper.merged(a, a)[2] == [[n[0], n[1], *html_wrapper.merged(x, n)[2:]] for x, n in zip(a[2], a[2], strict=True)]
    assert both[2] == html_wrapper.merged(b, a)[2]


def test_wrappers_stay_bounded():
    rng = random.Random(3)
    names = ["p", "ul", "h2", "h3", "pre", "table", "figure", "blockquote"]
    whole = None
    for k in range(60):
        body = "".join(f"<{(n := rng.choice(names))} class=c{rng.choice('abcdefghijklmnopqrst')}{rng.choice('uvwxyz')}>{sentence(rng, 2)}</{n}>" for _ in range(150))
        page = html_wrapper.of_page(parse(f"<article>{body}</article>"), k)
        whole = html_wrapper.bounded(html_wrapper.merged(whole, page)) if whole else page
        text = html_wrapper.Wrapper(whole).text(parse(f"<article>{body}</article>"))
        assert text.count("\n") == 149

    def size(n):
        return 1 + sum(map(size, n[2] or [])) if n[0] != "#" else 1

    assert size(whole) <= html_wrapper.NODES


# --- the filter audit


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([5, 150, 250]))) for _ in range(12)] + [" ".join(f"w{i}" for i in range(210)), "LOUD WORDS " * 120, "price: 5$ " * 3, "", "É ß 日本"]
    rows = [(i, rng.choice(texts + [None]), rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(7, rows[7][1], "en"), (None, texts[0], "en"), (None, texts[0], "en"), (500, "x y " * 20_000, "")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 140, 2)] + [(None, 1, 1), (7, 1, 0), (7, 0, 0)]
    return rows, labels


def brute_audit(rows, labels):
    first, good, toxic = {}, set(), set()
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if t == 1 else set()
    docs = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        docs.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before, upto = set(order[: step - 1]), set(order[:step])
                gone = [d for d in mine if letter in d[1] and not d[1] & before]
                shapley[letter] += len(gone)
                lines.append([part, order, step, sum(not d[1] & upto for d in mine), len(gone), sum(letter in d[1] and bool(d[1] & before) for d in mine), sum(d[1] == {letter} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)])
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def test_audit_equals_brute_force(spark, audit_rows):
    rows, labels = audit_rows
    docs = spark.createDataFrame([(*r, 0, "y") for r in rows], "doc_id long, text string, lang string, quality int, part string")
    got = filter_audit.audit(docs, spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, text string"))
    assert [c for c, _ in got.dtypes] == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_steps_of_all_prefixes(spark):
    got = filter_audit.steps(spark, "ABC").toPandas()
    assert len(got) == (3 + 6 + 6) * 8 and set(got["prefix"].str.len()) == {1, 2, 3} and (got["prefix"].str[-1] == got["letter"]).all()
    one = got[(got["prefix"] == "BA") & (got["mask"] == 0b011)].iloc[0]
    assert not one["kept"] and not one["removed"] and one["redundant"] and not one["unique_fails"]


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_fill_in_middle"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ordered = lambda f: f[sorted(f.columns)].sort_values(sorted(f.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(ordered(queries.QUERIES[name](spark, SF).toPandas()), ordered(con.sql(queries.ORACLES[name]).df()), check_dtype=False)


# --- fill in the middle


def brute_middle(text, key):
    n = len(text)
    h = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[i : i + 8], 16) for i in range(0, 32, 8)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    if h[3] % 100 < 20:
        return n, "spm", "<S>" + text[hi:] + "<P>" + text[:lo] + "<M>" + text[lo:hi], lo, hi - lo
    return n, "psm", "<P>" + text[:lo] + "<S>" + text[hi:] + "<M>" + text[lo:hi], lo, hi - lo


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("<>PSM\n"), st.characters(exclude_categories=["Cs"])), max_size=40), st.integers(0, 10**6), st.integers(1, 50))
def test_any_text_is_cut_and_restored(text, key, stretch):
    got = fim.transform(text, str(key), fim.Cutter(stretch=stretch))
    assert got == brute_middle(text, key) and fim.restore(got[2], got[1]) == text


def test_documents_with_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "no key"), (5, "has <S> inside"), (6, "é日́x" * 400_000), (-7, "negative key"), (2**62, "large key")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, output string, n int")
    got = fim.fill_in_middle(docs)
    want = sorted((k or 0, *brute_middle(t or "", "null" if k is None else k)) for k, t in rows)
    found = got.collect()
    assert sorted((r["doc_id"] or 0, r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) for r in found) == want
    assert sorted(r["restored_sha256"] for r in found) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert all(r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() for r in found)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_units_other_than_code_points():
    cutter = fim.Cutter(r"\w+\s*|\W")
    assert cutter.cuts("one two  three!", [0, 1, 2, 3, 4]) == (4, [0, 4, 9, 14, 15])
    with pytest.raises(ValueError, match="cover"):
        fim.Cutter("a").ends("ab")
