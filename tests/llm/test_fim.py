import hashlib
import re

from pyspark.sql import functions as F

from docloom.llm import fill_middle

from . import cases


def brute(i, text, seed=42, share=50, spm=80):
    t = text or ""
    w = re.findall(fill_middle.TOKEN, t)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, z = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:z]), "".join(w[z:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= share:
        return (i, len(w), "plain", None, None, t)
    if h4 % 100 < spm:
        return (i, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


EXTRA = ["<P> in it", "a <S", "S> b <M", "<", "<<P", " lead", "tail \n", "  nbsp em", "tab\there\x0bvt", "x\x00y z", "𝒳 😀 é", "' quote \" \\ {0}", "<S", "S>", "<P"] * 6


def test_matches_brute_force_and_comes_back(spark):
    rows = cases.texts() + EXTRA
    docs = cases.frame(spark, rows).union(spark.createDataFrame([(None, "no id at all", "en", "s", "id", "h", "words", 1, "label")], cases.SCHEMA))
    source = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    for share in (50, 100, 0):
        out = fill_middle.fill_middle(docs, share=share).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr) == sorted((brute(i, t, share=share) for i, t in source), key=repr)
        assert sorted(((r.id, r.back) for r in out), key=repr) == source
        assert all(r.output_sha256 == cases.sha(r.output.encode()) for r in out)
    assert {r.form for r in fill_middle.fill_middle(docs, share=100).collect()} == {"plain", "spm", "psm"}
    assert fill_middle.fill_middle(cases.empty(spark)).count() == 0
