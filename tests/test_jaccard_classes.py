import tempfile

from jobsight.plans import q_dedup


def test_jaccard_pairs_links_classes(spark, monkeypatch):
    """Every pair of copies is listed, but only one of them meets other postings."""
    linked, plain = [], q_dedup._jaccard_links

    def links(sets, *rest):
        linked.append(sets.count())
        return plain(sets, *rest)

    monkeypatch.setattr(q_dedup, "_jaccard_links", links)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(4)]
    one, near, far = " ".join(words[:12]), " ".join(words[:13]), " ".join(words[8:])
    texts = {1: "\n".join([one] * 6), 2: "\n".join([near] * 3 + [far]), 3: one, 4: one}
    source = {1: "s", 2: "s", 3: "t", 4: None}
    top = tempfile.mkdtemp(prefix="jobsight-test-")
    spark.createDataFrame([(i, "en", source[i], t) for i, t in texts.items()], "doc_id long, lang string, source string, text string") \
        .write.parquet(f"{top}/documents.parquet")
    got = [(r.url1, r.url2, r.jaccard) for r in q_dedup.jaccard_pairs(spark, top).collect()]
    lines = sorted([("s", one, f"doc/1/{n}") for n in range(1, 7)] + [("s", near, f"doc/2/{n}") for n in range(1, 4)])
    want = [(a[2], b[2], 1.0 if a[1] == b[1] else round(12 / 13, 6)) for k, a in enumerate(lines) for b in lines[k + 1:]]
    assert sorted(got) == sorted(want)
    assert linked[0] <= 4 + 1  # one, near, far of s; one of t (and of none)
