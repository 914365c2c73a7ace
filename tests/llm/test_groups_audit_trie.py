"""MinHash groups, the audit of filters and the trie of prefixes against brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from placetrend.llm import filter_audit, minhash_join, prefix_trie, queries
from placetrend.llm.shared import WORD
from tests.llm.fixtures import awkward, empty, listed, sentence
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
WORDS = re.compile(WORD)


@pytest.mark.parametrize("name", ["op11_minhash_join", "op12_filter_audit", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, queries.QUERIES[name], queries.ORACLE[name]) is None


# --- MinHash groups -----------------------------------------------------------------------------


def shingles(text, width=4):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, 1)))


def plain_join(table, percent=80):
    """doc_id, n_shingles, component_id, kept of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in table]
    kinds = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    root = list(range(len(kinds)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(kinds):
        for j in range(i):
            if 100 * len(a & kinds[j]) >= percent * len(a | kinds[j]):
                root[find(i)] = find(j)
    place = {s: k for k, s in enumerate(kinds)}
    least = defaultdict(list)
    for (i, _), s in zip(table, sets, strict=True):
        if s and i is not None:
            least[find(place[s])].append(i)
    out = []
    for (i, _), s in zip(table, sets, strict=True):
        component = min(least[find(place[s])], default=i) if s else i
        out.append((i, len(s), component, i is not None and i == component))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_minhash_groups_on_awkward_rows(spark):
    df, rows = awkward(spark)
    assert listed(minhash_join.minhash_groups(df), *COLUMNS) == plain_join([(i, t) for i, t, _ in rows])


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_a_large_group_of_near_copies_branches_and_loses_no_link(spark, monkeypatch):
    """Hundreds of texts near one another, chains that only single links hold together, and a passage
    that many otherwise different texts share."""
    rng = random.Random(5)
    base = sentence(rng, 120).split()
    table = [(k, edited(rng, base, rng.randrange(1, 6))) for k in range(120)]
    chain = sentence(rng, 100).split()
    for k in range(12):
        table.append((1000 + k, " ".join(chain)))
        chain[8 * k : 8 * k + 3] = [f"x{k}", f"y{k}", f"z{k}"]
    passage = sentence(rng, 60)
    table += [(2000 + k, f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}") for k in range(120)]
    rng.shuffle(table)
    depths = []
    original = minhash_join._children
    monkeypatch.setattr(minhash_join, "_children", lambda *a: depths.append(1) or original(*a))
    found = minhash_join.minhash_groups(spark.createDataFrame(table, "doc_id int, text string"))
    assert listed(found, *COLUMNS) == plain_join(table)
    assert depths  # nodes of more than a few sets branched


def test_pairs_of_a_node_are_bounded(spark, monkeypatch):
    rng = random.Random(6)
    base = sentence(rng, 200).split()
    table = [(k, edited(rng, base, 1 + k % 2)) for k in range(400)]
    pairs = []
    original = minhash_join._confirmed
    monkeypatch.setattr(minhash_join, "_confirmed", lambda p, *a: pairs.append(p.count()) or original(p, *a))
    assert minhash_join.minhash_groups(spark.createDataFrame(table, "doc_id int, text string")).where("kept").count() == 1
    assert sum(pairs) < 400 * minhash_join.FEW


def test_sets_that_meet_no_other_in_a_tree_are_not_sent_to_its_root(spark, monkeypatch):
    rng = random.Random(9)
    table = [(k, sentence(rng, 60)) for k in range(100)]
    sent = []
    original = minhash_join._top_nodes
    monkeypatch.setattr(minhash_join, "_top_nodes", lambda t: sent.append(t.count()) or original(t))
    assert minhash_join.minhash_groups(spark.createDataFrame(table, "doc_id int, text string")).where("kept").count() == 100
    assert sum(sent) < 2 * minhash_join.TREES * 10  # all were sent to all before


def test_whole_sets_are_sent_for_few_pairs_that_are_not_similar(spark, monkeypatch):
    """Texts near one another, but not near enough, and two copies of one of them."""
    rng = random.Random(10)
    base = sentence(rng, 200).split()
    table = [(k, edited(rng, base, 10)) for k in range(80)] + [(100, " ".join(base)), (101, edited(rng, base, 1))]
    sent = {True: 0, False: 0}
    original = minhash_join._sets_of

    def counted(docs, id_column, text_column, width, wanted, short):
        sent[short] += wanted.count()
        return original(docs, id_column, text_column, width, wanted, short)

    monkeypatch.setattr(minhash_join, "_sets_of", counted)
    found = minhash_join.minhash_groups(spark.createDataFrame(table, "doc_id int, text string"))
    assert listed(found, *COLUMNS) == plain_join(table)
    assert sent[True] > 40 and sent[False] < 20  # whole sets of all of them before


def test_short_sets_have_no_less_in_common(monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(minhash_join, "SHORT", 3000)
    words = sentence(rng, 5000).split()
    for a, b in ((words[:2500], words[400:]), (words[:2500], words[400:2800]), (words[:4000], words[500:]), (words[:30], words[:29]), (words[:9], words[20:30])):
        sets = [minhash_join.shingle_set(" ".join(x).encode()) for x in (a, b)]
        both = len(np.intersect1d(*sets))
        most = minhash_join.most_in_common(*map(minhash_join.shortened, sets))
        assert both <= most <= both + 0.1 * max(map(len, sets))


def test_minwise_tokens_agree_as_often_as_sets_do():
    rng = random.Random(7)
    words = sentence(rng, 4000).split()
    a, b = (minhash_join.shingle_set(" ".join(x).encode()) for x in (words[:3600], words[400:]))
    jaccard = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    (ta, sa), (tb, sb) = minhash_join.minwise(a), minhash_join.minwise(b)
    assert abs((ta == tb).mean() - jaccard) < 0.13
    apart = sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(sa, sb, strict=True))
    assert abs(apart / 128 - (1 - jaccard) / 2) < 0.12


def test_parts_of_a_long_text_give_the_same_set(monkeypatch):
    text = sentence(random.Random(8), 500).encode()
    whole = minhash_join.shingle_set(text).tolist()
    from placetrend.llm import shared

    monkeypatch.setattr(minhash_join, "pieces_of", lambda t: shared.pieces_of(t, 50))
    assert minhash_join.shingle_set(text).tolist() == whole and len(minhash_join.shingle_set(b"one two")) == 1


# --- the audit of filters -----------------------------------------------------------------------


def plain_mask(text):
    words = WORDS.findall(text or "")
    failed = (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text or "")) > 3 * len(text or ""), bool(re.search(r"[#$%&*|]", text or "")),
    )
    return {x for x, f in zip("ABCD", failed, strict=True) if f}


def plain_audit(table, labels):
    """Every order applied to every row of (doc_id, text, part)."""
    rows = []
    for i, t, p in table:
        failed = plain_mask(t)
        if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in table):
            failed.add("E")
        good, toxic = (any(x[0] == i and i is not None and x[k] == 1 for x in labels) for k in (1, 2))
        rows.append((p or "", failed, good, toxic))
    found = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                failing = sum(x in r[1] for r in own)
                unique = sum(r[1] == {x} for r in own)
                lines.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone), x))
                removed_by[x] += len(gone)
        found += [(*line[:-1], removed_by[line[-1]]) for line in lines]
    return sorted(found, key=repr)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_awkward_rows(spark):
    df, rows = awkward(spark)
    rng = random.Random(9)
    table = [(i, t, s) for i, t, s in rows] + [(100 + k, sentence(rng, 250) + " # A" * (k % 3), "src1") for k in range(8)]
    table += [(200, "Ab " * 300, None), (201, "Ab " * 300, ""), (None, "Ab " * 300, "src1")]
    labels = [(1, 1, 0), (1, 0, 1), (7, 1, 1), (100, 1, None), (101, None, 1), (None, 1, 1), (200, 1, 0), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "m", "l") for r in table], "doc_id bigint, text string, lang string, mask string, least string")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    assert listed(filter_audit.audit(docs, marks), *AUDIT) == plain_audit(table, labels)


def test_intervals_cover_each_order_once(spark):
    for n in (1, 2, 3, 4):
        orders = list(permutations(range(n)))
        for r in filter_audit.intervals(spark, n).collect():
            found, at = set(), {rank: sign for rank, sign in r.ends}
            depth = 0
            for rank, order in enumerate(orders):
                depth += at.get(rank, 0)
                if depth:
                    found.add(order)
            failing = {x for x in range(n) if r.mask >> x & 1}
            expected = {o for o in orders if o[r.step - 1] in failing and bool(failing & set(o[: r.step - 1])) == r.late}
            assert found == expected


def test_audit_of_three_filters(spark):
    masks = spark.createDataFrame([("p", 5, True, False)] * 3 + [("p", 0, True, True), ("q", 2, False, True)], "part string, mask int, good boolean, toxic boolean")
    rows = filter_audit.filter_audit(masks, "XYZ").collect()
    assert len(rows) == 2 * 6 * 3
    first = next(r for r in rows if r.part == "p" and r.filter_order == "ZXY" and r.step == 1)
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.good_lost, first.shapley) == (1, 3, 0, 0, 3, 9)


# --- the trie of prefixes -----------------------------------------------------------------------


def plain_trie(table):
    turns = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    convs = {}
    for c, v in own.items():
        base, h = c - c % 20, zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[convs[c][:d]].append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(path))
        children = {p: sum(q[: len(p)] == p and len(q) == len(p) + 1 for q in members) for p in below}
        out.append(
            (
                ids[0], len(path), members[path[:-1]][0] if path else None, len(ids), children[path], sum(n == 0 for n in children.values()),
                sum((len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id bigint, turn bigint, role string, text string, p1 string, i string, task string, base string"


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], TURNS)


def talks(rng):
    rows = []
    for c in [*range(0, 45), 60, 61, 62, 145, 146, 999]:
        script = rng.randrange(4)
        for k in range(rng.randrange(1, 7)):
            text = f"said {script} {k}" if rng.random() < 0.7 else sentence(rng, 3)
            rows.append((c, k, ("user", "assistant")[k % 2], text))
    rows += [(7, None, None, None), (7, None, "user", "first"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "assistant", "tie")]
    rows += [(None, 0, "user", "nobody"), (61, 9, None, " \t"), (400, 0, "", ""), (1401, 0, "user", "alone")]
    return rows


@pytest.mark.parametrize("block", [3, 4096])
def test_trie_of_awkward_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    rows = talks(random.Random(block))
    assert listed(prefix_trie.conversation_trie(turn_table(spark, rows)), *TRIE) == plain_trie(rows)


def test_a_full_sketch_only_proves_less(spark, monkeypatch):
    rows = talks(random.Random(3))
    monkeypatch.setattr(prefix_trie, "LEAST_BITS", 6)
    monkeypatch.setattr(prefix_trie, "MOST_BITS", 6)
    assert listed(prefix_trie.conversation_trie(turn_table(spark, rows)), *TRIE) == plain_trie(rows)


def test_one_conversation_of_many_turns_is_numbered_over_tasks(spark):
    rows = [(5, k // 2, "user", f"t {k // 2}") for k in range(3000)] + [(5, None, "user", "z")] * 3 + [(25, 0, "user", "x")]
    random.Random(1).shuffle(rows)
    turns = prefix_trie.ordered_turns(turn_table(spark, rows).repartition(6))
    found = turns.where("conv_id = 5").orderBy("i").select("i", "t1").collect()
    assert [r.i for r in found] == list(range(1, 3004))
    sums = {r.t1 for r in found[:3]}
    assert len(sums) == 1 and all(found[k].t1 == found[k + 1].t1 for k in range(3, 3003, 2))


def test_many_copies_share_one_chain_of_nodes(spark):
    rows = [(c, k, "user", f"w{k} x") for c in range(0, 400, 20) for k in range(5)]
    found = {r.depth: r for r in prefix_trie.conversation_trie(turn_table(spark, rows)).collect()}
    assert len(found) == 6 and found[0].saved_tokens == 19 * 10 and found[5].n_convs == 20
    assert found[5].ends_sha256 == hashlib.sha256(",".join(map(str, range(0, 400, 20))).encode()).hexdigest()


@pytest.mark.parametrize("name", ["groups", "audit", "trie"])
def test_empty_tables(spark, name):
    df = empty(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    run = {
        "groups": lambda: minhash_join.minhash_groups(df), "audit": lambda: filter_audit.audit(df.withColumn("lang", F.lit("x")), labels),
        "trie": lambda: prefix_trie.conversation_trie(turn_table(spark, [])),
    }
    assert run[name]().count() == 0


def test_texts_without_words_are_linked_with_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A")], "doc_id int, text string")
    assert listed(minhash_join.minhash_groups(df), *COLUMNS) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)]
