import hashlib
import random

from clanmark.llm import reply_trees as R

from . import samples

KIND = "tree long, node long, parent long, role string, text string, score double"


def test_branches_rank_by_score(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", 9.0),
        (1, 5, 3, "user", "d", 0.0), (2, 1, 77, "user", "lone", None), (None, 1, None, "user", "n", 1.0), (None, 2, 1, "assistant", "m", 1.0),
    ]
    df = spark.createDataFrame(rows, KIND)
    got = {(r.tree, r.branch): r.formatted for r in R.format_paths(df, best=None).collect()}
    assert got == {
        (1, 1): "[INST] q[/INST]<s>a</s>[INST] c[/INST]",
        (1, 2): "[INST] q[/INST]<s>b</s>[INST] d[/INST]",
        (2, 1): "[INST] lone[/INST]",
        (None, 1): "[INST] n[/INST]<s>m</s>",
    }
    assert {(r.tree, r.branch) for r in R.format_paths(df, best=1).collect()} == {(1, 1), (2, 1), (None, 1)}


def test_round_trip_of_any_text_and_role(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "&lt;&amp;[&lsqb;", "<s>", "a\nb", " x ", "É日\U0001f600", "&nl;\n", "<<SYS>>x\n<</SYS>>", "]" * 3, "\\[$1"]
    roles = ["user", "assistant", "system", None, "", "ro\nle&nl;", "<s>", "User", "tool[1]"]
    rows = [(c, t, roles[(t + c) % len(roles)], odd[(t * 5 + c) % len(odd)]) for c in range(12) for t in range(15)]
    df = spark.createDataFrame([*rows, (None, None, "user", "x"), (None, 2, "assistant", "y")], "conv_id long, turn long, role string, text string")
    lines = R.format_paths(R.linear(df))
    got = {
        r.tree: (r.turns, r.learned, r.formatted, r.loss)
        for r in lines.select("tree", "formatted", "loss", R.read_turns(R.F.col("formatted")).alias("turns"), R.read_loss(R.F.col("formatted"), R.F.col("loss")).alias("learned")).collect()
    }
    for c in range(12):
        turns, learned, formatted, loss = got[c]
        want = [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert [tuple(t) for t in turns] == want
        assert learned == "".join(t for r, t in want if r == "assistant")
        assert sum(s.length for s in loss) == sum(len(formatted[s.start : s.start + s.length]) for s in loss)
    assert [tuple(t) for t in got[None][0]] == [("user", "x"), ("assistant", "y")]


def test_digests(spark):
    rows = [(5, 1, "assistant", "<a>"), (5, 0, "user", None), (5, 2, "user", "[x]"), (6, 0, "user", "only")]
    got = {r.conv_id: r for r in R.digests(R.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    plain = "user\n\nassistant\n<a>\nuser\n[x]\n"
    assert got[5].n_turns == 3 and got[5].turns_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert got[5].loss_chars == 3 and got[5].loss_sha256 == hashlib.sha256(b"<a>").hexdigest()
    assert got[6].loss_chars == 0 and got[6].loss_sha256 == hashlib.sha256(b"").hexdigest()
    none = samples.empty(spark).selectExpr("doc_id AS conv_id", "doc_id AS turn", "text AS role", "text")
    assert R.digests(R.linear(none)).count() == 0


def test_long_chain(spark):
    chain = spark.range(1, 1001).selectExpr("7L AS tree", "id AS node", "CASE WHEN id > 1 THEN id - 1 END AS parent", "'user' AS role", "string(id) AS text", "1.0D AS score")
    turns = R.format_paths(chain).select(R.read_turns(R.F.col("formatted")).alias("t")).first().t
    assert [t.text for t in turns] == [str(i) for i in range(1, 1001)]
    repeated = spark.createDataFrame([(1, 0, "user", "a")] * 3, "conv_id long, turn long, role string, text string")
    assert R.digests(R.linear(repeated)).first().n_turns == 3


def brute(rows, best):
    """Branches of every tree, parent by parent; the least of repeated nodes, none that lead into a circle."""
    trees = {}
    for tree, node, *rest in rows:
        own = trees.setdefault(tree, {})
        key = tuple((x is not None, x) for x in rest)
        if node is not None and (node not in own or key < own[node][0]):
            own[node] = key, rest
    out = {}
    for tree, own in trees.items():
        parents, found = {r[0] for _, r in own.values()}, []
        for node in own:
            path, at = [], node
            while at in own and at not in path:
                path.append(at)
                at = own[at][1][0]
            if at not in path and node not in parents:
                score = sum(own[n][1][3] or 0.0 for n in path) / len(path)
                found.append((-score, -len(path), node, "".join(own[n][1][2] for n in reversed(path))))
        for k, (*_, text) in enumerate(sorted(found)[:best], 1):
            out[tree, k] = text
    return out


def test_random_forests_with_repeated_nodes_and_circles(spark):
    draw = random.Random(4)
    rows = []
    for tree in range(25):
        n = draw.randint(1, 14)
        nodes = [(tree, i, draw.choice([None, *range(1, i)]) if i > 1 else None, "user", f"m{i} ", float(draw.randint(0, 3))) for i in range(1, n + 1)]
        if tree % 3 == 0:
            a, b = 100, 101
            nodes += [(tree, a, b, "user", "a ", 1.0), (tree, b, a, "user", "b ", 1.0), (tree, 102, a, "user", "c ", 9.0), (tree, 103, 103, "user", "d ", 9.0)]
        rows += nodes + [(*r[:4], r[4] + "again ", r[5]) for r in draw.choices(nodes, k=3)] + nodes[:1] + [(tree, None, 1, "user", "none", 1.0)]
    draw.shuffle(rows)
    got = {(r.tree, r.branch): r.formatted for r in R.format_paths(spark.createDataFrame(rows, KIND), best=3).collect()}
    plain = {k: "".join(t for t in v.replace("[INST] ", "").split("[/INST]")) for k, v in got.items()}
    assert plain == brute(rows, 3) and len(plain) > 40
    only = spark.createDataFrame([(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0)], KIND)
    assert R.format_paths(only).count() == 0
