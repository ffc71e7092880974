"""Each stage of the pipeline against plain Python, on its own input."""

import itertools
import re
import sys
from collections import defaultdict

import pytest
from test_exact import plain_matches, plain_roots

from docloom.llm import line_spread, temperature_mix

SF = "/root/testdata/sf0.001"
sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, rows in, rows out) of each stage, over all documents and some more that each stage has to act on."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    cut = [" ".join(t.split()[1:]) for t in first[:20]]
    more = [(10_000 + i, t, "en", f"s{i}", len(t)) for i, t in enumerate([*cut, "12 34", "½", "", None and "", "  "]) if t is not None]
    more += [(20_000 + i, f"the same line on every site\nown words of page number {i} here", "en", f"site{i}", 60) for i in range(12)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    out, folder = [], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((name, docs.collect(), made.collect()))
        docs = made
    return {name: (a, b) for name, a, b in out}


def test_language(stages):
    given, kept = stages["language"]
    assert {r.doc_id for r in kept} == {r.doc_id for r in given if re.search(r"[^\W\d_]", (r.text or "").replace("½", ""))}


def test_lines(stages):
    given, kept = stages["lines"]
    sites, homes = defaultdict(set), defaultdict(set)
    for r in given:
        homes[r.text].add(r.source)
        for x in r.text.split("\n"):
            sites[x.strip(line_spread.BLANK)].add(r.source)
    want = {}
    for r in given:
        left = "\n".join(x for x in r.text.split("\n") if not x.strip(line_spread.BLANK) or len(sites[x.strip(line_spread.BLANK)]) < 10)
        want[r.doc_id] = r.text if not left.strip(line_spread.BLANK) and len(homes[r.text]) > 1 else left
    assert {r.doc_id: (r.text, r.n_chars) for r in kept} == {k: (t, len(t)) for k, t in want.items()}
    assert "the same line on every site" not in {x for r in kept for x in r.text.split("\n")}


def test_near_duplicates(stages):
    given, kept = stages["near_duplicates"]
    sets = {r.doc_id: shingles(r.text) for r in given}
    by_set = defaultdict(list)
    for k, s in sets.items():
        by_set[s].append(k)
    nodes = [min(v) for v in by_set.values()]
    alike = [(a, b) for a, b in itertools.combinations(nodes, 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(alike) >= 10
    want = set(plain_roots(nodes, alike).values())
    got = {r.doc_id for r in kept}
    assert want <= got and len(got - want) <= 0.02 * len(nodes)


def test_benchmark(spark, stages):
    given, kept = stages["benchmark"]
    items = [r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in given} - {r.doc_id for r in kept} == {r.doc_id for r in given if any(plain_matches(r.text or "", q) for q in items)}


def test_mixture(stages):
    given, kept = stages["mixture"]
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in given)
    words = {r.doc_id: len(re.findall(temperature_mix.WORDS, r.text or "")) for r in given}
    assert all(r.n_tokens == words[r.doc_id] for r in kept)
    total, drawn = sum(words.values()), sum(r.copies * r.n_tokens for r in kept)
    longest = max(words.values())
    assert total - len({r.source for r in kept}) * longest <= drawn <= total + len(kept)
