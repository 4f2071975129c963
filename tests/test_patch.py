"""A patch that is read in ranges against the same text in one row."""

import random

from millrace.operators import diff


def patch(rng, files):
    out = []
    for f in range(files):
        kind = rng.choice(["modified", "added", "deleted", "renamed"])
        old, new = f"d/f{f}.py", f"d/f{f}.py" if kind != "renamed" else f"d/g{f}.py"
        out.append(f"diff --git a/{old} b/{new}")
        out += {"modified": ["index 1..2 100644"], "added": ["new file mode 100644"], "deleted": ["deleted file mode 100644"], "renamed": [f"rename from {old}", f"rename to {new}"]}[kind]
        if rng.random() < 0.9:
            out += [f"--- a/{old}", f"+++ b/{new}"]
        for _ in range(rng.randrange(4)):
            body = [rng.choice(" +-") + rng.choice(["x = 1", "", "@@ odd", "diff --git a/x b/x", "é" * rng.randrange(60)]) for _ in range(rng.randrange(1, 25))]
            o, n = sum(b[0] in " -" for b in body), sum(b[0] in " +" for b in body)
            out.append(f"@@ -{rng.randrange(1, 900)},{o} +{rng.randrange(1, 900)},{n} @@ def g{f}():")
            out += body
    return "\n".join(out) + "\n"


COLUMNS = ["file_no", "hunk_no", "path", "old_path", "change_type", "is_python", "old_start", "old_lines", "new_start", "new_lines", "hint", "header", "diff_content", "added_lines", "removed_lines", "context_lines", "added_at", "removed_at"]


def test_ranges_give_the_hunks_of_the_whole(spark, tmp_path):
    rng = random.Random(8)
    texts = {f"p{i}.diff": patch(rng, n) for i, n in enumerate((24, 1, 6))} | {"none.diff": "no diff here\n", "late.diff": "commit 1\n\n" + patch(rng, 5)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = diff.read_patch(spark, str(tmp_path / "*.diff"))
        assert spark.read.text(str(tmp_path / "p0.diff")).rdd.getNumPartitions() > 2
        got = sorted(((r.review_id.rsplit("/", 1)[1], *(r[c] for c in COLUMNS)) for r in got.collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = diff.hunks(spark.createDataFrame(list(texts.items()), "review_id string, diff string"))
    want = sorted(((r.review_id, *(r[c] for c in COLUMNS)) for r in want.collect()), key=str)
    assert got == want and len(got) > 25
