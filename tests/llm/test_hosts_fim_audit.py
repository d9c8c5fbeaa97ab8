"""Host trust, fill-in-middle and the filter audit against brute force, on odd tables."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest

from pubmetrics.llm import audit, fim, hosts
from pubmetrics.llm.queries import QUERIES, URL_RULES

from .conftest import WORD

PAGES = [
    (1, "http://WWW.Example.com/en/1", '<a href="https://a.org/x">x</a><a href="//b.org">'),
    (2, "http://example.com/en/1?q=1", "<A HREF = 'HTTP://A.org:80/y#z'> href=//c.org/"),
    (3, "https://x.net/fr/1#top", '<link href=https://b.org?x><a href="/rel"><a href="mailto:q@q">'),
    (4, "https://x.net/de/1", '<a href="http://x.net/self">'),
    (4, "https://x.net/de/1", None),
    (None, "http://b.org/p", '<a href="http://x.net/fr/1">' * 3),
    (6, "http://c.org", '<a href="http://x.net/">'),
    (7, "http://c.org?no/path", ""),
    (8, None, '<a href="http://x.net/">'),
    (9, "no scheme/en/", None),
    (10, "://", None),
    (11, "ftp://m.c.org/en/?://q", None),
    (12, "http://net/es/", "<a href='http://d.org'>"),
    (13, "http://othernet/es/", None),
    (14, "http://.net/es/é", None),
    (15, "http://d.org/" + "x" * 100_000, "y" * 300_000),
    (16, "http://com", None),
    (17, "http://q.com/", None),
]


def judged(pages, rules, family=1.0, threshold=hosts.THRESHOLD):
    """Plain Python: verdicts, and the sums by matrices."""
    rows = []
    for key, url, html in pages:
        rest = (url or "").split("://", 1)
        rest = rest[1] if len(rest) > 1 else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        rows.append((key, host, path, best[1], best[2], html or ""))
    names = sorted({r[1] for r in rows} - {""})
    edges = collections.Counter()
    for r in rows:
        if r[1]:
            found = {m.lower() for m in re.findall(r"""href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", r[5], re.I)}
            for dst in found - {r[1]}:
                edges[r[1], dst] += 1
    for h in names:
        edges[h, h] += sum(r[1] == h for r in rows)
    for below, up in {(".".join(x[i:]), ".".join(x[i + 1 :])) for x in (h.split(".") for h in names) for i in range(len(x) - 2)}:
        edges[below, up] += family
        edges[up, below] += family
    nodes = sorted({x for e in edges for x in e} | set(names))
    at = {h: i for i, h in enumerate(nodes)}
    weight = np.zeros((len(nodes), len(nodes)))
    for (a, b), w in edges.items():
        weight[at[a], at[b]] = w
    seeds = np.zeros((2, len(nodes)))
    for h in names:
        own = [r[4] for r in rows if r[1] == h]
        seeds[0, at[h]] = own.count("allow") / len(own)
        seeds[1, at[h]] = own.count("block") / len(own)
    with np.errstate(invalid="ignore", divide="ignore"):
        along = np.nan_to_num(weight / weight.sum(1, keepdims=True))
        against = np.nan_to_num(weight.T / weight.T.sum(1, keepdims=True))
    total, term = seeds.copy(), seeds.copy()
    while term.sum() > hosts.TOLERANCE * seeds.sum():
        term = hosts.DAMPING * np.stack([term[0] @ along, term[1] @ against])
        total += term
    total *= 1 - hosts.DAMPING
    out = collections.Counter()
    for key, host, path, rule, verdict, _ in rows:
        t, d = total[:, at[host]] if host else (0.0, 0.0)
        out[key, host, path, rule, verdict or ("block" if d - t >= threshold else "allow"), round(t, 6), round(d, 6)] += 1
    return out


def test_link_graph_rows(spark, tmp_path):
    odd = [(*p, "k", 1, "r", "x") for p in PAGES]
    spark.createDataFrame(odd, "page_id long, url string, html string, key string, host int, rule string, decided string").write.parquet(f"{tmp_path}/pages.parquet")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.trust, 6), round(r.distrust, 6)) for r in QUERIES["op11_link_graph"](spark, str(tmp_path)).collect())
    assert got == judged(PAGES, URL_RULES)
    ranks = {k[1]: k[4:] for k in got if k[3] is None}
    assert ranks["b.org"][2] > 0 and ranks["x.net"][1] > 0 and ranks[""] == ("allow", 0, 0)  # b.org and x.net link to each other


def test_link_graph_on_random_hosts_and_empty_tables(spark):
    rng = np.random.default_rng(4)
    tops = ["com", "net", "org"]
    name = lambda: f"{rng.choice(['', 'm.', 'a.m.'])}h{rng.integers(12)}.{tops[rng.integers(3)]}"
    pages = [(i, f"http://{name()}/{['en', 'fr', 'es'][rng.integers(3)]}/", " ".join(f'<a href="http://{name()}/">' for _ in range(rng.integers(4)))) for i in range(300)]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = collections.Counter((r.key, r.host, r.path, r.rule, r.verdict, round(r.trust, 6), round(r.distrust, 6)) for r in hosts.judge(frame, rules).collect())
    assert got == judged(pages, URL_RULES)
    assert hosts.judge(frame.where("false"), rules).count() == 0
    assert {r.verdict for r in hosts.judge(frame, rules.where("false")).collect()} == {"allow"}


def filled(key, text):
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = np.random.default_rng(2)
    letters = list("<PSM>aé😀́ \n")
    texts = [None, "", "x", "<", "<P", "a<M>b", "<P>", "<<PS", "😀" * 5000, "aé\0" * 200_000]
    texts += ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no key at all"), (7, texts[7]), (7, "another text"), (None, None)]


@pytest.mark.parametrize("chunk", [3, fim.CHUNK])
def test_fill_in_middle(spark, chunk):
    rows = odd_texts() if chunk > 3 else [(k, (t or "")[:500]) for k, t in odd_texts()]
    docs = spark.createDataFrame([(k, t, 1, "f") for k, t in rows], "doc_id long, text string, row int, form string").repartition(3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = collections.Counter()
    for k, t in rows:
        form, a, m, out = filled(k, t or "")
        wanted[k, len(t or ""), form, a, m, sha(out), sha(t or "")] += 1
    outputs = fim.outputs(docs, chunk=chunk)
    got = collections.Counter(tuple(r)[1:] for r in fim.restored(outputs).collect())
    assert got == wanted
    # The pieces are the outputs, and outputs read from a table restore alike.
    texts = collections.defaultdict(bytes)
    for r in outputs.orderBy("row", "pos").collect():
        texts[r.row] += bytes(r.piece)
        assert len(bytes(r.piece)) <= 4 * chunk + 3
    assert collections.Counter(hashlib.sha256(t).hexdigest() for t in texts.values()) == collections.Counter(r for *_, r, _ in wanted.elements())
    shuffled = outputs.repartition(5, "pos")
    again = collections.Counter(tuple(r)[1:] for r in fim.restored(fim.ordered(shuffled)).collect())
    assert again == wanted
    assert fim.restored(fim.outputs(docs.where("false"))).count() == 0


def test_marks_across_pieces():
    own = (0, 0, 0, "psm", 0, 0)
    whole = b"<P>a<<P<S>S><S<M><M"
    for cut in range(1, 5):
        rows = [(*own, i, whole[i : i + cut], None) for i in range(0, len(whole), cut)]
        found = collections.defaultdict(bytes)
        for _, place, body in fim.sections(iter(rows)):
            found[place] += body
        assert found == {0: b"a<<P", 2: b"S><S", 1: b"<M"}


def test_filter_audit(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = [None, "", " \n", "w " * 250, "A " * 300, "#", " ".join(f"w{i}" for i in range(210)), "É" * 50 + " A", " ".join(f"W{i}" for i in range(205)) + " |"]
    rows = [(int(rng.integers(0, 150)), texts[rng.integers(len(texts))], [None, "", "s1", "s2"][rng.integers(4)]) for _ in range(400)]
    rows += [(None, texts[3], "s2"), (None, texts[3], "s3"), (-1, "s9 alone", "s3")]
    labels = [(int(rng.integers(0, 150)), int(rng.integers(2)), int(rng.integers(2))) for _ in range(90)] + [(5, None, 1), (None, 1, 1)]
    spark.createDataFrame([(k, t, s, "x", 3) for k, t, s in rows], "doc_id long, text string, source string, key string, A int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    good, toxic = ({k for k, *marks in labels if k is not None and marks[i] == 1} for i in (0, 1))
    plain = collections.defaultdict(list)
    for k, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and k > least[t])
        plain[s or ""].append((dict(zip("ABCDE", fails)), k in good, k in toxic))
    wanted = {}
    for part, docs in plain.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for i, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                total[f] += len(gone)
                failing = [d for d in docs if d[0][f]]
                wanted[part, "".join(order), i + 1] = [len(left), len(gone), len(failing) - len(gone), sum(sum(d[0].values()) == 1 for d in failing), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), v in wanted.items():
            if p == part:
                v.append(total[order[step - 1]])
    got = QUERIES["op13_filter_audit"](spark, str(tmp_path)).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == wanted and len(got) == len(wanted)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    assert audit.interactions(audit.flagged(empty, spark.read.parquet(f"{tmp_path}/labels.parquet")), "ABCDE", {"good_lost": "good"}).count() == 0


def test_audit_of_two_filters(spark):
    rows = spark.createDataFrame([("p", True, None), ("p", True, True), ("p", False, False)], "part string, x boolean, y boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit.interactions(rows, "xy", {}).collect()}
    assert got == {("xy", 1): (1, 2, 0, 1, 3), ("xy", 2): (1, 0, 1, 0, 1), ("yx", 1): (2, 1, 0, 0, 1), ("yx", 2): (1, 1, 1, 1, 3)}
