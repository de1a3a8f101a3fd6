"""Repeated lines and sentences against a plain version: rows with one id, null ids, repeated rows, the text that stays."""

import hashlib
import random
import re

from plumbline.llm import line_dedup


def plain(data, min_words, sentence_words):
    ranked = sorted(range(len(data)), key=lambda k: (data[k][0] is None, data[k][0] or 0, hashlib.sha256((data[k][1] or "").encode()).hexdigest(), k))
    seen, out = set(), []
    for k in ranked:
        i, text = data[k][0], data[k][1] or ""
        n, spans, kept, at, lines = 0, [], [], 0, text.split("\n")
        for j, line in enumerate(lines):
            found, words = [], re.findall(r"[^\x20\x09-\x0D]+", line.lower())
            if words and len(words) >= min_words:
                found.append((0, len(line), words))
            pieces = list(re.finditer(r"[^.!?]+[.!?]*|[.!?]+", line))
            for m in pieces if len(pieces) > 1 else []:
                some = re.findall(r"[^\x20\x09-\x0D]+", m[0].lower())
                if len(some) >= sentence_words:
                    found.append((*m.span(), some))
            gone = []
            for a, b, w in found:
                n += 1
                if tuple(w) in seen:
                    gone.append((a, b))
                seen.add(tuple(w))
            if (0, len(line)) in gone:
                spans.append((at, at + len(line)))
            else:
                spans += [(at + a, at + b) for a, b in gone]
                keep = "".join(c for p, c in enumerate(line) if not any(a <= p < b for a, b in gone))
                kept.append(keep + ("\n" if j < len(lines) - 1 else ""))
            at += len(line) + 1
        out.append((i, n, len(spans), sum(b - a for a, b in spans), [a for a, _ in spans], [b for _, b in spans], "".join(kept)))
    return sorted(map(repr, out))


def test_units(spark):
    r = random.Random(5)
    sentences = ["one two three.", " Four five six seven!", " eight nine ten", "A  B c.", " ONE two three.", "", ".", " x y z?!"]
    texts = ["\n".join("".join(r.choices(sentences, k=r.randint(0, 4))) for _ in range(r.randint(0, 4))) for _ in range(60)]
    data = [(k // 2 if k < 40 else k, t) for k, t in enumerate(texts)] + [(None, None), (None, texts[0]), (None, texts[1]), (7, ""), (2**53 + 1, texts[2]), (2**53 + 3, "no. " * 30_000 + "é one two three.")]
    r.shuffle(data)
    frame = spark.createDataFrame([(*d, "clash", 1) for d in data], "doc_id long, text string, row string, line int").repartition(3)
    got = line_dedup.repeated_units(frame, min_words=2, sentence_words=3, texts=True).collect()
    assert sorted(repr((x.doc_id, x.n_units, x.n_removed, x.removed_chars, x.starts, x.ends, x.kept_text)) for x in got) == plain(data, 2, 3)
    assert all(x.kept_sha256 == hashlib.sha256(x.kept_text.encode()).hexdigest() for x in got)


def test_equal_rows_count_once(spark):
    text = "the very same line of words here\nown"
    got = line_dedup.repeated_units(spark.createDataFrame([(1, text), (1, text), (None, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted(x.n_removed for x in got) == [0, 1, 1, 1] and len(got) == 4
