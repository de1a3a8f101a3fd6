import random

from plumbline.llm import line_dedup


def test_lines(spark):
    r = random.Random(2)
    lines = ["a b c d e", "A  b c d E", "short line", "", "one two three four five six", "é ü x y z w"]
    data = [(k, "\n".join(r.choices(lines, k=r.randint(0, 6)) + [f"own line of document number {k}"])) for k in range(40)] + [(50, None), (51, ""), (None, "a b c d e"), (52, "w " * 50_000 + "\n" + "a b c d e")]
    r.shuffle(data)
    first, want = {}, {}
    for i, t in sorted(data, key=lambda x: (x[0] is None, x[0] or 0)):
        starts, ends, at, n = [], [], 0, 0
        for line in (t or "").split("\n"):
            w = line.split()
            if len(w) >= 5:
                n += 1
                if " ".join(w).lower() in first:
                    starts.append(at), ends.append(at + len(line))
                first.setdefault(" ".join(w).lower(), i)
            at += len(line) + 1
        want[i] = (n, len(starts), sum(ends) - sum(starts), starts, ends)
    got = line_dedup.repeated_lines(spark.createDataFrame([(*d, "clash") for d in data], "doc_id long, text string, digest string").repartition(3))
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == want
    assert line_dedup.without("a\nbb\nc", [2], [4]) == "a\nc"
    assert line_dedup.repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
