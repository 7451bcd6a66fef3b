import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from terraloom.llm import queries, repair, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, n=40, most=9):
    """Few distinct turns, so that beginnings are shared; nulls, repeated rows, ties and clashing extra columns."""
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(-3, 230), n), 0, 100]:
        for t in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "Why?", " ", "", None, "Long text! Then more", "ok.\n"])
            rows.append((c, rng.choice([t, t, t, None, 3 * t]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return sorted(set(rows), key=str) + rows[:5]


def in_order(rows):
    def digest(r):
        role, text = r[2] or "", r[3] or ""
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))


def plain_trie(rows):
    by = {}
    for r in rows:
        if r[0] is not None:
            by.setdefault(r[0], []).append(r)
    by = {c: [(r[2] or "", r[3] or "") for r in in_order(rs)] for c, rs in by.items()}
    built = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = by.get(first, [])[:h] + own[h:]
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        return [path] + [x for p in children.get(path, []) for x in below(p)]

    out = []
    for path, ms in members.items():
        sub = below(path)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in sub)
        text = ",".join(map(str, sorted(ends.get(path, []))))
        out.append((min(ms), len(path), min(members[path[:-1]]) if path else None, len(ms), len(children.get(path, [])), sum(1 for p in sub if p not in children), saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "block"), [(1, 3), (2, 20), (3, 8192)])
def test_trie_against_plain_one(spark, seed, block):
    rows = conversations(seed)
    rows += [(None, 1, "user", "no id")]
    if seed == 1:  # one long conversation, so that components are chains too
        rows += [(7, t, "user", f"t{t % 5}") for t in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("x"), "rep": F.lit(1), "digest": F.lit(None).cast("string")})
    got = trie.summary(trie.with_borrowed_heads(trie.turns_in_order(df)), block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_conversations_as_they_are_and_of_none(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")]
    got = trie.summary(trie.with_length(trie.turns_in_order(spark.createDataFrame(rows, SCHEMA))), 1).orderBy("depth").collect()
    assert [(r.conv_id, r.n_convs, r.n_leaves, r.saved_tokens) for r in got] == [(1, 2, 1, 1), (1, 2, 1, 1), (1, 1, 1, 0)]
    none = trie.with_borrowed_heads(trie.turns_in_order(spark.createDataFrame([], SCHEMA)))
    assert trie.summary(none).count() == 0


def test_centroids_against_plain_sums():
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 200):
        for shape in (lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i), lambda i: max(0, i - rng.randrange(1, 4))):
            parent = [-1, *[shape(i) for i in range(1, n)]]
            values = [[rng.randrange(9) for _ in range(n)] for _ in range(2)]
            want = [list(v) for v in values]
            for i in range(n - 1, 0, -1):
                for w in want:
                    w[parent[i]] += w[i]
            assert trie.split_at_centroids(parent, values) == want


def plain_repair(rows):
    """rows of one conversation in order -> counts, least (cost, audit) of all edit lists, and the repaired turns."""
    count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    seen, kinds = set(), []
    for i, (_, role, text) in enumerate(rows):
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated"
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            count[kind] += 1
        if i and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
            count["illegal"] += 1
    legal = re.compile(r"(s?(ua)+)?")
    starts = re.compile(r"s?(ua)*u?")
    best = None
    todo = [(0, "", 0, "", ())]
    while todo:
        cost, audit, i, roles, out = todo.pop()
        if best and cost > best[0] or not starts.fullmatch(roles):
            continue
        if i == len(rows) and legal.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if not audit.endswith("III"):
            todo += [(cost + 2, audit + "I", i, roles + r[0], (*out, r + ":")) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            todo.append((cost + 3, audit + "D", i + 1, roles, out))
            if kinds[i] not in ("blank", "duplicate"):
                more = cost + (kinds[i] == "truncated")
                todo += [(more + 2, audit + "R", i + 1, roles + r[0], (*out, f"{r}:{text}")) for r in ("user", "assistant")]
                if role[:1] in ("s", "u", "a"):
                    todo.append((more, audit + "K", i + 1, roles + role[0], (*out, f"{role}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *[count[c] for c in ("blank", "duplicate", "truncated", "illegal")], best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def plain_damage(rows):
    by = {}
    for c, t, role, text in rows:
        own = by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f:
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            own += [(t, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in by.items()}


@pytest.mark.parametrize("limits", [{}, {"most_rows": 2, "chunk": 3}, {"most_bytes": 12, "chunk": 1}])
def test_repair_against_all_edit_lists(spark, limits):
    rows = conversations(11, 60, 5) + [(None, None, None, None), (None, 2, "user", "no id."), (None, 9, "user", "no id.")]
    rows += [(500 + k, k, r, t) for k, (r, t) in enumerate([("system", "Alone."), ("assistant", "Alone."), ("user", "Alone."), ("x", "Alone."), ("usurper", "Alone.")])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"k": F.lit("x"), "fault": F.lit(1), "part": F.lit(1)})
    damaged, dropped = repair.damaged(df)
    got = repair.report(repair.repair(damaged, dropped, **limits)).collect()
    want = {c: plain_repair(own) for c, own in plain_damage(rows).items()}
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert len(got) == len(want)


def test_repaired_turns_are_legal(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "There?"), (2, 0, "assistant", "Cut off")]
    out = repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "step").collect()
    assert [(r.edit, r.role, r.text) for r in out if r.conv_id == 1 and r.edit] == [("K", "user", "Hi."), ("D", "user", "Hi."), ("R", "assistant", "There?")]
    assert [r.cost for r in out if r.edit is None] == [5, 3]
    assert repair.report(repair.repair(spark.createDataFrame([], SCHEMA))).count() == 0


def test_queries_are_registered():
    assert {"op11_conversation_trie", "op13_conversation_repair"} <= set(queries.QUERIES)
