"""Chat formatting and the repair of conversations, against plain versions."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import oracle
import pytest
from conftest import SMALL

from streamgrid.llm import chat_tree, turn_repair
from streamgrid.llm.queries import QUERIES, SQL, damaged

TABLES = SMALL.replace("0.001", "0.01")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL, OPEN = re.compile("(s?(ua)+)?"), re.compile("(s?(ua)*u?)?")


def cheapest(rows):
    """All sequences of edits with at most two insertions between rows: the least (cost, audit, repaired rows)."""

    @functools.cache
    def rest(i, initials, inserted):
        found = [(0, "", ())] if i == len(rows) and LEGAL.fullmatch(initials) else []
        steps = []
        if inserted < 2:
            steps += [(2, "I", r, "", i, inserted + 1) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, gone, cut = rows[i]
            steps.append((3, "D", None, None, i + 1, 0))
            if not gone:
                steps += [(cut, "K", role, text, i + 1, 0)] if role else []
                steps += [(2 + cut, "R", r, text, i + 1, 0) for r in ("user", "assistant")]
        for cost, edit, role, text, j, ins in steps:
            now = initials + (role[:1] if role else "")
            if OPEN.fullmatch(now) and (best := rest(j, now[:-2] if len(now) > 3 else now, ins)):
                said = () if role is None else (f"{role}:{text}",)
                found.append((cost + best[0], edit + best[1], said + best[2]))
        return min(found, default=None)

    return rest(0, "", 0)


def plain_repair(rows):
    """The contract over (turn, role, text) rows of one conversation after damage."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    seen, marked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        if fault:
            faults[fault] += 1
        seen.add((role, text))
        marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, repaired = cheapest(tuple(marked))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    return (gaps, *faults.values(), illegal, cost, audit, digest)


def odd_conversations(rng, count):
    said = ["a.", "b!", "c", "d?", " ", "", None, "e. ", "<|im_end|>", "x\n", "é"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "st\nar"]
    rows = []
    for conv in [None, *range(count)]:
        for turn in range(rng.randint(1, 7)):
            row = (conv, rng.choice([turn, turn, turn, None, turn + 3, 0]), rng.choice(roles), rng.choice(said))
            rows += [row] * rng.choice([1, 1, 1, 2])
    return rows


def by_conversation(rows):
    found = {}
    for conv, *rest in rows:
        found.setdefault(conv, []).append(tuple(rest))
    return found


def audits(df):
    names = [*turn_repair.COUNTS, "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in names) for r in df.collect()}


@pytest.mark.parametrize("compact_at", [1, 7, 10**9])
def test_cheapest_audit_and_its_rows(compact_at):
    rng = random.Random(compact_at)
    for _ in range(400):
        rows = [
            (rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", rng.random() < 0.2, int(rng.random() < 0.3))
            for i in range(rng.randint(0, 7))
        ]
        repair = turn_repair.Repair(compact_at)
        for i, (role, text, gone, cut) in enumerate(rows):
            repair.add(i, role, text, gone, False, bool(cut))
        cost, audit, repaired = cheapest(tuple(rows))
        assert repair.result()[5:] == (cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def test_audits_compare_as_their_texts():
    rng, tree = random.Random(4), turn_repair.AuditTree()
    nodes = [0]
    for _ in range(400):
        nodes.append(tree.push(rng.choice(nodes[-30:]), rng.choice(b"DIKR")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert tree.less(a, b) == (tree.text(a) < tree.text(b))
        depth = rng.randint(0, tree.depth[a])
        assert tree.text(tree.ancestor(a, depth)) == tree.text(a)[:depth]
    # Hashes that collide are found out.
    for node in nodes:
        tree.value[node] = 7
    for _ in range(1000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert tree.less(a, b) == (tree.text(a) < tree.text(b))


def test_long_undecided_audits_stay_small_per_row():
    repair = turn_repair.Repair()
    for i in range(20_000):
        repair.add(i, "tool", "x.", False, False, False)
    assert repair.result()[5:7] == (40_000, "R" * 20_000)
    repair = turn_repair.Repair()
    for i in range(100_000):
        repair.add(i, "user" if i % 2 == 0 else "assistant", "x.", False, False, False)
    assert len(repair.tree) < 70_000 * 3
    assert repair.result()[6] == "K" * 100_000


def test_repair_of_odd_tables(spark):
    rows = odd_conversations(random.Random(2), 60)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", duplicate string, n int")
    assert audits(turn_repair.audit(df)) == {c: plain_repair(r) for c, r in by_conversation(rows).items()}
    assert turn_repair.audit(df.limit(0)).count() == 0
    assert turn_repair.repaired_turns(df.limit(0)).count() == 0


def test_repaired_turns_are_those_of_the_digest(spark):
    rows = odd_conversations(random.Random(3), 40)
    df = spark.createDataFrame(rows, SCHEMA)
    said = {}
    for r in turn_repair.repaired_turns(df).orderBy("step").collect():
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, found in audits(turn_repair.audit(df)).items():
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == found[-1]


def plain_damage(rows):
    for conv, turn, role, text in rows:
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def test_repair_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/conversations.parquet").select(*SCHEMA.replace(",", "").split()[::2]).collect()]
    left = by_conversation(plain_damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    wanted = {c: plain_repair(left[c]) if c in left else nothing for c in by_conversation(rows)}
    assert audits(QUERIES["op13_turn_repair"](spark, TABLES)) == wanted


def test_damage_of_odd_rows(spark):
    rows = odd_conversations(random.Random(6), 60)
    found = [tuple(r) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(found, key=repr) == sorted(plain_damage(rows), key=repr)


def test_templates_are_reversible():
    rng = random.Random(8)
    for _ in range(5000):
        role, text = ("".join(rng.choice(["<", "|", "\\", "\n", "n", "<|im_end|>", "x"]) for _ in range(rng.randint(0, 9))) for _ in "ab")
        turn = chat_tree.format_turn(role, text)
        assert chat_tree.parse_turn(turn) == (role, text)
        assert turn.count("<|") == 2


@pytest.mark.parametrize("sf_dir", [SMALL, TABLES])
def test_chat_query(spark, sf_dir):
    assert oracle.differences(QUERIES["op12_chat_tree"](spark, sf_dir), oracle.connect(sf_dir), SQL["op12_chat_tree"]) is None


def shared_conversations(rng, count):
    """Conversations that begin alike, copies, beginnings of others, and one longer than the sort key."""
    rows, known = [], [[("system", "s")], []]
    for conv in range(count):
        turns = list(rng.choice(known))[: rng.randint(0, 9)]
        turns += [(rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randint(0, 3)) for _ in range(rng.randint(0, 3))]
        turns = turns or [("user", None)]
        known.append(turns)
        rows += [(conv, i, *t) for i, t in enumerate(turns)]
    for conv in (count, count + 1, count + 2):
        rows += [(conv, i, "user" if i % 2 else "assistant", "x" if i < 80 else str(conv % 2)) for i in range(90)]
    return rows


def test_the_tree_shares_turns_and_reads_back(spark):
    rows = shared_conversations(random.Random(5), 150)
    df = spark.createDataFrame(rows, SCHEMA)
    packed = chat_tree.pack(df).orderBy("block", "n").collect()
    wanted = {c: [(r or "", x or "") for _, r, x in sorted(t, key=lambda r: r[0])] for c, t in by_conversation(rows).items()}
    ends, written = {}, {}
    for r in packed:
        if r["turn"] is not None:
            written.setdefault(r["block"], []).append(r)
    for r in packed:
        if r["is_end"]:
            text = "".join(w["turn"] for w in written[r["block"]])
            ends[r["conv_id"]] = "".join(text[s["start"] : s["end"]] for s in r["attends"])
            assert r["position"] == len(ends[r["conv_id"]])
    assert ends == {c: "".join(chat_tree.format_turn(*t) for t in turns) for c, turns in wanted.items()}
    for block in written.values():
        text, paths = "".join(w["turn"] for w in block), set()
        for w in block:
            above = "".join(text[s["start"] : s["end"]] for s in w["attends"])
            assert (len(above), text[w["start"] : w["end"]]) == (w["position"], w["turn"])
            role, said = chat_tree.parse_turn(w["turn"])
            assert (w["loss_start"] is not None) == (role == "assistant")
            if w["loss_start"] is not None:
                assert chat_tree.unescape(text[w["loss_start"] : w["loss_end"]]) == said
            # A turn is written once in its block: no two have the same turns above and the same text.
            assert (above, w["turn"]) not in paths
            paths.add((above, w["turn"]))
    back = {}
    for r in chat_tree.unpack(chat_tree.pack(df)).orderBy("conv_id", "depth").collect():
        back.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert back == wanted


def test_chat_of_odd_tables(spark):
    rows = odd_conversations(random.Random(12), 40)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", depth string, block int")
    con = oracle.duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    sql = SQL["op12_chat_tree"]
    start = sql.index("UNION ALL SELECT -1")
    own = sql[:start] + sql[sql.index(")\nSELECT conv_id, count(*)") :]
    assert oracle.differences(chat_tree.digest(chat_tree.pack(df)), con, own) is None
    assert chat_tree.digest(chat_tree.pack(df.limit(0))).count() == 0
    assert chat_tree.unpack(chat_tree.pack(df.limit(0))).count() == 0
