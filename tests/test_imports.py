"""Pages, robots files, pasted groups, merged materials, decoding states, audits: against plain versions."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tests.test_verse import GOOD
from versemill.functions import tables as T
from versemill.operators import agent as ag
from versemill.operators import audit as au
from versemill.operators import decode as dc
from versemill.operators import dedup as dd
from versemill.operators import sample as sm
from versemill.operators import web
from versemill.sources import html, readers


class Plain(HTMLParser):
    """Lines of a page, written straight down."""

    def __init__(self):
        super().__init__()
        self.out, self.now, self.depth = [], "", 0

    def flush(self):
        line = re.sub("[ \t\xa0]+", " ", self.now).strip()
        self.out += [line] if line else []
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.depth += tag in html.HIDDEN
        if self.depth == 0 and tag in html.BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in html.HIDDEN))
        if self.depth == 0 and tag in html.BLOCKS - {"br"}:
            self.flush()

    def handle_data(self, data):
        self.now += data if self.depth == 0 else ""


def test_pages_of_random_tags():
    r = random.Random(7)
    parts = ["<p>", "</p>", "<div>", "</div>", "<br>", "<br/>", "<nav>", "</nav>", "<svg>", "</svg>", "<b>", "</b>", "một", " hai\xa0 ", "\n", "&amp;", "</footer>", "<header>", "</header>", "<li>ba</li>", "</br>"]
    for _ in range(400):
        page = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.flush()
        assert html.rendered(page)["lines"] == plain.out, page


def test_metadata_and_hidden_elements():
    page = '<META Name="AUTHOR" content=" An "><nav><meta property="og:title" content="T"><p>no<nav>no</nav>no</nav>a<br>b<script>x<p>y</script><meta name=date content=""><meta name=other content=z>'
    got = html.rendered(page)
    assert got["lines"] == ["a", "b"] and dict(got["meta"]) == {"author": "An", "og:title": "T"}
    assert html.rendered(None) is None and html.rendered("") == {"lines": [], "meta": []}


def test_robots(spark):
    text = "# x\nUser-agent: a\nUser-agent: Mill\nDisallow: /p  # note\nAllow: /p/ok\nDisallow:\n\nUser-agent: b\nDisallow: /\n"
    files = spark.createDataFrame([("h.example", text), ("empty.example", ""), ("none.example", None)], "host string, robots string")
    urls = ["https://h.example/p", "https://H.example/p/ok/1", "http://h.example", "https://h.example?q=1", "https://other.example/p", "ftp://h.example/p", "", None, "https://empty.example/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    got = {r.id: r.allowed for r in readers.allowed_by_robots(pages, readers.robots_rules(files, "mill")).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: True}
    everyone = {r.id: r.allowed for r in readers.allowed_by_robots(pages, readers.robots_rules(files)).collect()}
    assert everyone[0] is True


def folded(windows):
    """One pass over the groups in order."""
    seen, out = set(), {}
    for grp in sorted({g for g, _, _ in windows}):
        occupied = set()
        for _, pos, digest in sorted(w for w in windows if w[0] == grp):
            span = set(range(pos, pos + 4))
            if span & occupied:
                out[grp, pos] = "overlap"
            elif digest in seen:
                out[grp, pos] = "repeat"
            else:
                seen.add(digest)
                occupied |= span
                out[grp, pos] = "taken"
    return out


def test_groups_fold_as_in_one_pass(spark):
    r = random.Random(3)
    for n, letters in ((40, "abcdefgh"), (12, "abc"), (25, "abcdefghijklmnopqrstuvwxyz")):
        windows = [(g, p, r.choice(letters)) for g in range(n) for p in range(12) if r.random() < 0.7]
        got = {(x.grp, x.pos): x.state for x in web.fold_groups(spark.createDataFrame(windows, "grp long, pos int, digest string")).collect()}
        assert got == folded(windows)
    assert web.fold_groups(spark.createDataFrame([], "grp long, pos int, digest string")).collect() == []


def test_manual_import_counts(spark):
    lines = GOOD.split("\n")[:4]
    rows = [(1, lines), (2, ["một", "hai"]), (3, lines + lines), (4, ["x"]), (5, None), (6, ["a b c d e f", "g", "h", "k"])]
    records, short, audit = web.manual_import(spark.createDataFrame(rows, "grp long, lines array<string>"))
    got = audit.first().asDict()
    # the repeat at the beginning of the third group leaves its lines to the window after it
    assert {(r.grp, r.pos, r.bucket) for r in records.collect()} == {(1, 0, "strict"), (3, 2, "strict")} and [r.text for r in short.collect()] == ["một\nhai"]
    assert (got["source_groups"], got["two_line_units"], got["under_four_lines"], got["windows_scanned"]) == (6, 1, 2, 7)
    assert (got["strict_records"], got["review_records"], got["exact_duplicates"], got["overlap_rejected"]) == (2, 0, 1, 1)


def test_materials_keep_one_reference_a_row(spark):
    rows = [(5, "a", "u"), (1, "a", "v"), (9, "a", "u"), (3, "b", None), (70_000, "a", "v"), (200_000, "a", "w"), (4, None, "z")]
    materials, references = dd.merge_materials(spark.createDataFrame(rows, "k long, t string, r string"), F.col("t"), "k", F.col("r"))
    of = {r.text_sha256: (r.first, r.n) for r in materials.collect()}
    refs = {}
    for r in references.orderBy("place").collect():
        refs.setdefault(of[r.text_sha256][0], []).append((r.place, r.ref))
    assert sorted(of.values()) == [(1, 5), (3, 1), (4, 1)]
    assert refs[1] == [(1, "v"), (2, "u"), (3, "u"), (4, "v"), (5, "w")] and refs[3] == [(1, None)]


def test_places_in_order(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS d")
    got = [r.d for r in sm.ordered_places(rows, "d").orderBy("place").collect()]
    assert got == sorted(got) and len(got) == 5000
    assert sm.ordered_places(rows.limit(0), "d").collect() == []


def test_foreign_words_are_those_listed():
    assert {"guy", "led", "dien", "there", "have", "his", "a", "i"} <= set(T.FOREIGN) and not {"an", "in", "so", "no", "to"} & set(T.FOREIGN) and len(T.FOREIGN) == 28


def test_audit_fails_on_invalid_ratings(spark):
    schema = "n string, i string, s string, d string"
    good = spark.createDataFrame([("4", "4", "0", "accept" if k < 8 else " Reject") for k in range(10)], schema)
    row = au.audit_summary(good, "n", "i", "s", "d").first()
    assert row.gate_passed and (row.rated, row.accepted, row.rejected, row.accept_rate, row.naturalness) == (10, 8, 2, 0.8, 4.0)
    bad = good.union(spark.createDataFrame([("6", "4", "0", "accept"), ("x", "1", "0", "accept"), (None, "1", "0", "accept"), ("1", "1", "2", "accept"), ("1", "1", "0", "maybe")], schema))
    with pytest.raises(Exception, match="outside its domain"):
        au.audit_summary(bad, "n", "i", "s", "d").collect()
    row = au.audit_summary(bad, "n", "i", "s", "d", strict=False).first()
    assert (row.n, row.rated, row.invalid, row.gate_passed, row.accept_rate) == (15, 10, 5, False, 0.8)
    assert au.audit_summary(good.limit(0), "n", "i", "s", "d").first().rated == 0


def test_retries_stop_at_the_first_eligible_candidate(spark):
    rows = [("p", 1, 0, 0.9, False, False), ("p", 1, 1, 0.8, True, True), ("p", 2, 2, 0.1, True, False), ("p", 3, 3, 0.7, True, False), ("q", 1, 0, 0.5, False, False), ("q", 2, 1, 0.6, False, None), ("q", 3, 2, 0.6, False, None), ("q", 4, 3, 0.9, True, None)]
    df = spark.createDataFrame(rows, "pool string, attempt int, idx int, score double, valid boolean, hard_fail boolean")
    got = {r.pool: (r.attempts, r.candidates, r.available, r.best) for r in ag.retried_until_eligible(df, 2).collect()}
    assert got == {"p": (2, 3, True, 2), "q": (3, 3, False, 1)}


def test_states_of_a_decoder(spark):
    schema = "state string, root int, path string, line string, word_pos int, couplets int, stop int, finished boolean, after_bat boolean, tones int, groups array<int>, next_tones int, next_groups array<int>"
    any_ = (7, None, 7, None)
    rows = [
        ("done", 0, "", "luc", 1, 1, None, True, True, *any_), ("stop", 0, "", "luc", 1, 1, 1, False, True, *any_), ("free", 0, "", "luc", 1, 1, None, False, True, *any_), ("mid", 0, "", "luc", 1, 0, None, False, False, *any_),
        ("line", 1, " \x01t\x01a", "luc", 6, 0, 1, False, False, *any_), ("word", 1, " \x01t\x01a", "luc", 5, 0, 1, False, False, 7, None, 4, None), ("part", 0, "t", "luc", 1, 0, 1, False, False, 4, None, 7, None), ("want", 0, "t", "luc", 1, 0, 1, False, False, 1, [7], 7, None), ("never", 0, "t", "luc", 1, 0, 1, False, False, 2, [9], 7, None),
    ]
    trie = spark.createDataFrame(
        [(0, "t", "t", 5, [3, 7], False), (0, "t\x01a", "a", 1, [7], True), (0, "t\x01á", "á", 4, [3], True), (1, " ", " ", 5, [3, 7], False), (1, " \x01t", "t", 5, [3, 7], False), (1, " \x01t\x01a", "a", 1, [7], True), (1, " \x01t\x01á", "á", 4, [3], True), (1, " \x01t\x01a\x01i", "i", 1, [8], True)],
        "root int, path string, token string, tone_bits int, gids array<int>, complete boolean",
    )
    got = {}
    for r in dc.allowed_set(spark.createDataFrame(rows, schema), trie).collect():
        got.setdefault(r.state, set()).add((r.token, r.kind, r.relaxed))
    assert got["done"] == got["stop"] == {(None, "end", False)} and got["line"] == {(None, "line", False)}
    assert got["free"] == {(None, "end", False), ("t", "walk", False)} and got["mid"] == {("t", "walk", False)}
    assert got["word"] == {("i", "walk", False), (" ", "begin", False)} and got["part"] == {("á", "walk", False)}
    assert got["want"] == {("a", "walk", False)} and got["never"] == {("a", "walk", True), ("á", "walk", True)}
    masks = spark.createDataFrame([("t", 5, [3, 7]), (" ", 1, [7])], "token string, tone_bits int, gids array<int>")
    soft = {(r.state, r.token): r.penalty for r in dc.allowed_set(spark.createDataFrame(rows, schema), trie, masks, strict=False).collect()}
    assert soft["word", " "] == 1.5 and soft["part", "á"] == 0.0 and soft["never", "a"] == 0.0
    assert [r.text for r in dc.token_texts(spark.createDataFrame([("a",), ("z",)], "token string"), spark.createDataFrame([("a", "A")], "token string, text string")).orderBy("token").collect()] == ["A", ""]
