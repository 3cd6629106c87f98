"""Words, signatures, permutation, knapsack, M-tree and models against plain versions."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import html_wrapper as H
from marlstone.llm import langid, mixing, mtree, near_dup, sharding, toxicity
from marlstone.llm import words as W

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(text):
    return PATTERN.findall((text or "").translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=12))
def test_words_are_those_of_the_pattern(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    data, at = W.utf8(pa.array(texts, pa.string()))
    h, s, e, bounds = W.words(data, at)
    want = [plain_words(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert [W.plain(data, a, b).decode() for a, b in zip(s, e, strict=True)] == flat
    seen = {}
    for w, x in zip(flat, h, strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_pieces_dont_change_words(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é.Z9 ") for _ in range(rng.randint(0, 4000))) for _ in range(30)] + ["x" * 9000]
    data, at = W.utf8(pa.array(texts))
    whole = W.words(data, at)
    monkeypatch.setattr(W, "PIECE", 700)
    W.forget()
    for a, b in zip(whole, W.words(data, at), strict=True):
        assert (a == b).all()
    W.forget()


def test_signatures_are_unbiased_for_weighted_jaccard():
    rng = np.random.default_rng(0)
    m, z = 256, []
    for _ in range(80):
        n = int(rng.integers(5, 200))
        ids = rng.integers(0, 2**63, n).astype(np.uint64)
        wa = rng.integers(1, 9, n)
        wb = np.where(rng.random(n) < rng.random(), wa, rng.integers(1, 20, n))
        j = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        s = near_dup.signatures(np.repeat([0, 1], n), np.concatenate([ids, ids]), np.concatenate([wa, wb]), 2, m)
        z.append(((s[0] == s[1]).mean() - j) / np.sqrt(max(j * (1 - j), 1e-3) / m))
    assert abs(np.mean(z)) < 0.4 and np.std(z) < 1.4


def _signed(texts):
    got = near_dup._signer(5, 32, 6)(pa.array(texts, pa.string()))
    return [(r["node"], r["n"], tuple(r["bands"])) for r in got.to_pylist()]


def test_a_signature_depends_on_its_text_alone():
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(n)) for n in [1, 2, 4, 5, 6, 9, 12, 20, 40, 300, 3000] for _ in range(3)]
    texts += ["x y " * 400, "", None, "Ünï cödé " * 3]
    alone = [_signed([t])[0] for t in texts]
    assert _signed(texts) == alone
    order = list(range(len(texts)))
    for cut in (2, 5, 17):
        rng.shuffle(order)
        got = {i: s for k in range(0, len(order), cut) for i, s in zip(order[k : k + cut], _signed([texts[i] for i in order[k : k + cut]]), strict=True)}
        assert [got[i] for i in range(len(texts))] == alone


def test_recall_of_pairs_at_the_threshold_by_length():
    """Pairs of a similarity between 0.8 and 0.9 in different batches, texts of few words too."""
    rng = random.Random(4)
    for n in (9, 12, 15, 20, 40, 200):
        one, two = [], []
        while len(one) < 60:
            a = [str(rng.randint(0, 10**6)) for _ in range(n)]
            b = a + [str(rng.randint(0, 10**6)) for _ in range(max(1, (n - 4) // 5))]
            x, y = n - 4, len(b) - 4
            if 5 * x >= 4 * y:
                one.append(" ".join(a))
                two.append(" ".join(b))
        met = [any(u == v for u, v in zip(p[2], q[2], strict=True)) for p, q in zip(_signed(one), [_signed([t])[0] for t in two], strict=True)]
        assert sum(met) >= 58, n


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 1000, 4097])
def test_permutation_is_a_permutation_and_can_be_undone(n):
    x = np.arange(n)
    p = sharding.permute(x, n, 5)
    assert sorted(p.tolist()) == x.tolist()
    assert sharding.permute(p, n, 5, back=True).tolist() == x.tolist()
    if n > 100:
        assert p.tolist() != x.tolist() and p.tolist() != sharding.permute(x, n, 6).tolist()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 400), st.integers(1, 500))
def test_fit_is_within_bounds_and_exact_when_all_is_in_reach(sizes, budget, reach):
    lengths, counts = list(sizes), list(sizes.values())
    take = mixing.fit(lengths, counts, budget, reach)
    got = sum(a * b for a, b in zip(lengths, take, strict=True))
    assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and got <= 2 * budget
    if budget >= sum(a * b for a, b in zip(lengths, counts, strict=True)):
        assert take == counts


def test_knapsack_finds_the_best_sum():
    rng = random.Random(3)
    for _ in range(60):
        lengths = rng.sample(range(3, 40), 4)
        counts = [rng.randint(1, 3) for _ in lengths]
        left = rng.randint(1, 60)
        start = [0] * 4
        best = 0
        for a in range(counts[0] + 1):
            for b in range(counts[1] + 1):
                for c in range(counts[2] + 1):
                    for d in range(counts[3] + 1):
                        s = a * lengths[0] + b * lengths[1] + c * lengths[2] + d * lengths[3]
                        best = min(best, s, key=lambda x: (abs(x - left), x))
        # with no proportional start (large total), the dynamic programme alone decides
        total = sum(a * b for a, b in zip(lengths, counts, strict=True))
        if left < total and all(n * left // total == 0 for n in counts):
            take = mixing.fit(lengths, counts, left, 1 << 15)
            assert sum(a * b for a, b in zip(lengths, take, strict=True)) == best, (lengths, counts, left, start)


def test_mtree_is_exact_and_leaves_work_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 300
    x = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 5)
    x[100:160] = x[100]
    ids = rng.permutation(3000)
    pages = mtree.build(ids, x, page=32)
    seen = []
    for i in range(0, 3000, 61):
        s = x @ x[i]
        want = sorted((-int(v), int(j)) for v, j in zip(s, ids, strict=True) if j != ids[i])[:5]
        assert [(-a, b) for a, b in mtree.search(pages, x[i], ids[i], 5, seen)] == want
    assert np.mean(seen) < 1500


def test_cells_that_cannot_reach_the_best_stay_closed():
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(40, 16)) * 60
    x = np.floor(middles[np.arange(4000) % 40] + rng.normal(size=(4000, 16)) * 3)
    ids = np.arange(4000) * 3
    centers = mtree.pivots_of(x[:500], 40)
    cell = ((x[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
    radii = np.array([np.sqrt(((x[cell == c] - p) ** 2).sum(1).max()) for c, p in enumerate(centers)])
    trees = lambda c: (mtree.build(ids[part], x[part], page=16) for part in np.array_split(np.flatnonzero(cell == c), 2))  # noqa: E731 - two shards a cell
    asked = np.flatnonzero(ids % 50 == 0)
    seen, opened, alone = [], [], []
    got = mtree.answers(ids[asked].tolist(), x[asked], centers, radii, trees, 5, seen, opened)
    for i, found in zip(asked, got, strict=True):
        order = sorted((-int(s), int(j)) for s, j in zip(x @ x[i], ids, strict=True) if j != ids[i])[:5]
        assert [(-s, j) for s, j in found] == order
        one: list[int] = []
        mtree.answers([int(ids[i])], x[i : i + 1], centers, radii, trees, 5, None, one)
        alone.append(len(one))
    assert sum(seen) < 0.25 * len(asked) * 4000 and np.mean(alone) < 0.4 * len(centers)


def test_mtree_small_and_equal():
    x = np.repeat([[1.0, 2.0]], 400, 0)
    pages = mtree.build(np.arange(400), x, page=16)
    assert mtree.search(pages, x[0], 0, 3) == [(5, 1), (5, 2), (5, 3)]
    assert mtree.search(mtree.build(np.array([7]), np.array([[1.0]])), np.array([2.0]), 7, 3) == []


def test_ordinal_regression_orders_grades_and_shares_weights():
    rng = random.Random(4)
    mild, bad = ["meh", "dull"], ["vile", "foul"]
    texts, grades = [], []
    for i in range(900):
        g = i % 3
        words = [rng.choice("alpha beta gamma delta omega".split()) for _ in range(20)]
        if g:
            words += rng.sample(mild, 2) if g == 1 else mild + rng.sample(bad, 1)
        rng.shuffle(words)
        texts.append(" ".join(words))
        grades.append(g)
    model = toxicity.learn(texts[:600], [g > 0 for g in grades[:600]], grades[:600])
    assert (np.diff(model.theta) > 0).all()
    data, at = W.utf8(pa.array(texts[600:]))
    severity, p = model.severity(model.scores(data, at))
    g = np.array(grades[600:])
    assert severity[g == 0].mean() < 0.3 < 0.7 < severity[g == 1].mean() < 1.3 < 1.6 < severity[g == 2].mean()
    assert ((p > 0.5) == (g > 0)).mean() > 0.98


def test_toxicity_without_classes():
    for t, y in ((["a b", None], [False, False]), ([], []), (["x"], [True])):
        model = toxicity.learn(t, y)
        data, at = W.utf8(pa.array(["a", "", None], pa.string()))
        assert (model.severity(model.scores(data, at))[1] < 0.5).all()


def test_language_network_learns():
    rng = random.Random(5)
    make = lambda a: " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(60))
    alphabets = {"aa": "etaoinshr", "bb": "zqwxkjvbé", "cc": "äöüsdfgh"}
    rows = [(make(v), k) for k, v in alphabets.items() for _ in range(30)]
    net = langid.learn(rows, steps=120)

    class Held:
        value = net

    test = [(make(v), k) for k, v in alphabets.items() for _ in range(20)]
    out = langid._predict(Held)(pa.array([t for t, _ in test] + ["", None], pa.string())).to_pylist()
    assert np.mean([o["lang"] == k for o, (_, k) in zip(out, test, strict=False)]) > 0.95
    assert all(0 <= o["score"] <= 1 for o in out)
    assert langid.learn([]).langs == [] and langid.learn([("x", "en")]).langs == ["en"]


PAGE = "<html><body><nav><ul>{nav}</ul></nav><div class='ad'>Buy {i}</div><article><h1>T {i}</h1>{ps}</article><footer>c</footer></body></html>"


def page(i, paragraphs, links=3):
    return PAGE.format(i=i, nav="".join(f"<li><a href=/{k}>l{k}</a></li>" for k in range(links)), ps="".join(f"<p>{p}" for p in paragraphs))


def test_wrapper_is_a_union_free_expression():
    w = H.infer([page(1, ["a"]), page(2, ["b", "c"], 1), page(3, ["x"])])
    assert H.expression(w) == (
        "<html><body><nav><ul>(<li>#text</li>)+</ul></nav><div.ad>#text</div><article><h1>#text</h1>(<p>#text</p>)+</article><footer>'c'</footer></body></html>"
    )
    kept = {k for k, v in H.slots(w, 3).items() if v}
    assert kept == {"html/body/article/h1", "html/body/article/p"}


def test_wrapper_optional_and_grouped():
    a = "<div><h2>q</h2><p>1</p><h2>r</h2><p>2</p></div>"
    b = "<div><h2>s</h2><p>3</p></div><hr><table><tr><td>z</td></tr></table>"
    e = H.expression(H.infer([a, b]))
    assert "(<table>" in e and ")?" in e and "(h2 p)" not in e and ")+" in e


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<p", "<p"), ("plain  text", "plain text"), ("<script>x", ""), ("<!-- x", ""), ("&#65;&unknown; &lt;b", "A&unknown; <b"),
        ("<p>One<br>two<p>Three <b>four</b>", "One two\nThree four"), ("<style>p{}</style><p>a</p>", "a"), ("<ul><li>a<li>b</ul>", "a\nb"),
        ("<article><header><h1>T</h1></header><p>x</p><div class=comments>c</div></article><aside>s</aside>", "T\nx"),
        ("<header>h</header><div id=main-menu>m</div><div><p>x</p></div><form>f</form><div class=cookie-notice>n</div><footer>f</footer>", "x"),
        ("<div hidden>h</div><main><p>a</p></main><p>b</p>", "a"),
    ],
)
def test_text_of_a_page_alone(html, text):
    assert H.text_of(html, None) == text


@pytest.mark.parametrize("attrs", ["style='overflow:hidden'", 'style="overflow-x: hidden"', 'title="a hidden gem"', "data-x='id=menu'", "data-hidden", "title=a-hidden", "alt='class=ad hidden'"])
def test_only_attribute_names_hide(attrs):
    for tag in ("body", "article", "main", "div"):
        assert H.text_of(f"<{tag} {attrs}><p>x</p></{tag}>", None) == "x"
    for hidden in ("hidden", "HIDDEN", "hidden=''", "title='a b' hidden", "aria-hidden=true", "aria-hidden = 'true'"):
        assert H.text_of(f"<div {hidden}>h</div><p>x</p>", None) == "x"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_common_is_a_longest_common_subsequence(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    want, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            want.append((i, j))
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            want.append((i, -1))
            i += 1
        else:
            want.append((-1, j))
            j += 1
    assert list(H.common(a, b)) == want


def test_long_lists_are_aligned():
    rng = random.Random(3)
    lists = [[rng.choice(("p", "ul", "h2", "pre", "table", "dl", "ol")) for _ in range(n)] for n in (700, 900)]
    pages = ["<body><section>Same notice</section>" + "".join(f"<{t}>{k} {i}</{t}>" for i, t in enumerate(x)) + "</body>" for k, x in enumerate(lists)]
    body = H.infer(pages)[0]
    labels = [x.label for x in H.schema(H.parse(pages[0]))[0].kids], [x.label for x in H.schema(H.parse(pages[1]))[0].kids]
    assert len(labels[0]) * len(labels[1]) > 250_000
    assert body.kids[0].pages == 2 and body.kids[0].kids[0].text == "Same notice"
    both = sum(x.pages == 2 for x in body.kids)
    assert both > 0.5 * len(labels[0]) and len(body.kids) == len(labels[0]) + len(labels[1]) - both
    a, b = (rng.choices("abcdefgh", k=20_000) for _ in range(2))
    assert sum(i >= 0 and j >= 0 for i, j in H.common(a, b)) > 9000


@pytest.mark.parametrize("tag", ["article", "main"])
def test_sections_of_an_article_are_kept(tag):
    names = ["id=related-work", "id=legal-framework", "id=discussion", "id=comments", "class='search results'", "class=legal", "class=social-history", "id=ad class='wide form'", "class=feedback-loop", "class=ad-hoc"]
    body = "".join(f"<h2 id=search-{i}>h{i}</h2><section {n}><p>p{i}</p></section>" for i, n in enumerate(names))
    refs = "<ul><li><a href=/1>first reference</a><li><a href=/2>second reference</a></ul>"
    drop = "<div class='box ad'>x</div><div class=Comments>x</div><nav>x</nav><div role=navigation>x</div><div class=share-buttons>x</div>"
    want = [t for i in range(len(names)) for t in (f"h{i}", f"p{i}")] + ["first reference", "second reference"]
    html = f"<div class=legal>x</div><{tag}>{body}{refs}{drop}</{tag}>"
    assert H.text_of(html, None).split("\n") == want
    assert H.text_of(html, H.Wrapper(H.infer([html, html]))).split("\n") == want


def test_pages_are_matched_with_the_wrapper():
    html = "<body><div><p>Same on all pages</p></div><h2>{0}</h2><div><p>text {0}</p></div></body>"
    w = H.Wrapper(H.infer([html.format(i) for i in range(6)]))
    w.template = {b[0] for b in H.filled(html, w) if b[1] == "Same on all pages"}
    assert H.text_of(html.format("new"), w) == "new\ntext new"  # one path of tags, two slots
    assert H.text_of("<body><div><p>Same on all pages</p></div><h2>q</h2><section>s</section></body>", w) == "q\ns"
    hidden = H.Wrapper(H.infer(["<body><div hidden><p>a</p></div></body>", "<body><div><p>b</p></div></body>"]))
    assert H.text_of("<body><div><p>c</p></div></body>", hidden) == "c"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.tuples(st.sampled_from("abc"), st.booleans()), max_size=6), st.integers(0, 5), st.integers(0, 5))
def test_as_many_labels_as_can_be_are_placed(labels, sequence, lo, hi):
    reach = [i if loop else i - 1 for i, (_, loop) in enumerate(sequence)]
    if lo < hi < len(reach):
        reach[lo : hi + 1] = [hi] * (hi + 1 - lo)
    places = {x: [i for i, (y, _) in enumerate(sequence) if y == x] for x, _ in sequence}

    def most(k, at):
        if k == len(labels):
            return 0
        return max([most(k + 1, at), *(1 + most(k + 1, s) for s in places.get(labels[k], []) if s > at or at <= reach[s])])

    for got in (H.placed(labels, places, reach), H._placed_best(labels, places, reach)):
        on = [(k, s) for k, s in enumerate(got) if s >= 0]
        assert all(sequence[s][0] == labels[k] for k, s in on) and len(on) == most(0, -1)
        assert all(b > a or a <= reach[b] for (_, a), (_, b) in zip(on, on[1:]))


def test_bags_keep_multiplicity():
    h = np.array([1, 2, 3, 4, 5] * 3, np.uint64)
    doc, ids, weight = near_dup.bag(*near_dup.elements(h, np.array([0, 15])))
    assert Counter(weight.tolist()) == Counter([3, 2, 2, 2, 2])


@pytest.mark.parametrize("unit", ["<a ", "<a href='", '<a b=">" ', "<!x ", "</a ", "<!-- ", "<script ", "</script ", "<", "<p>x", "<x><h1>"])
def test_broken_markup_of_any_size_is_read_in_linear_time(unit):
    page = unit * (2_000_000 // len(unit)) + "<p>last</p>"
    began = time.process_time()
    H.parse(page)
    assert time.process_time() - began < 15


def test_tags_nested_deeper_than_any_limit():
    page = "<div>" * 30_000 + "deep" + "</div>" * 30_000
    w = H.Wrapper(H.infer([page, page.replace("deep", "other")]))
    assert H.text_of(page, w) == "deep"


def test_repeated_groups_of_any_length():
    unit = "".join(f"<{t}>{{}}</{t}>" for t in "h2 p pre ul table dl blockquote figure h3".split())
    items = H.infer(["<div>" + "".join(unit.format(*[f"{i} {k}" for k in range(9)]) for i in range(n)) + "</div>" for n in (4, 5)])
    assert H.expression(items).startswith("<div>(((<h2>#text</h2>)") and H.expression(items).endswith("))+</div>")
    assert H.periods(list("abcabc")) == [3] and H.periods(list("aabaab")) == [2, 3]


def test_pages_of_plain_divisions_need_the_wrapper():
    """No article, no telling class or id: what repeats over a host's pages is told by its wrapper alone."""
    def one(i):
        body = "".join(f"<div>Sentence {k} of page {i} about {i * 7 + k}.</div>" for k in range(2 + i % 3))
        return f"<div><div>Example Daily, all the news</div><div><a href=/>Home</a> <a href=/x>More</a></div><div><div>Title {i}</div>{body}</div><div>Printed by the Daily's printers</div></div>"

    pages = [one(i) for i in range(12)]
    w = H.Wrapper(H.infer(pages))
    texts = Counter()
    for p in pages:
        texts.update({(slot, text) for slot, text, *_ in H.filled(p, w)})
    slots_ = Counter(slot for slot, _ in texts)
    w.template = {s for (s, _), n in texts.items() if slots_[s] == 1 and n >= 6}
    w.links = {s for p in pages for s, text, linked, *_ in H.filled(p, w) if linked * 2 >= len(text)}
    for i, p in enumerate(pages):
        want = "\n".join([f"Title {i}", *(f"Sentence {k} of page {i} about {i * 7 + k}." for k in range(2 + i % 3))])
        assert H.text_of(p, w) == want and H.text_of(p, None) != want


def test_what_remains_of_a_budget_beyond_the_reach():
    """Few very long documents: nothing shorter is left, and the nearer of none and one more is taken."""
    assert mixing.fit([10, 10**9], [3, 2], 10**9 + 30, 100) == [3, 1]
    assert mixing.fit([10, 10**9], [3, 2], 10**9 - 5000, 100) == [3, 1]
    assert mixing.fit([10, 10**9], [3, 2], 4 * 10**8, 100) == [3, 0]
