"""Markdown of parsed documents: many at once, each parsed once, with documents, articles and paragraphs that are empty or alike."""

from pyspark.sql import functions as F

from strandlake.sources import legal_xhtml as L


def article(k, chapter, paragraphs):
    head = f'<p class="oj-ti-section-1">{chapter}</p>' if chapter else ""
    body = "".join(f'<div id="00{k}.00{i}">' + "".join(f"<p>{x}</p>" for x in lines) + "</div>" for i, lines in enumerate(paragraphs, 1))
    return f'{head}<div id="art_{k}"><p class="oj-ti-art">Article {k}</p><div class="eli-title"><p>T{k}</p></div>{body}</div>'


def expected(articles):
    out, last = "", ""
    for k, chapter, paragraphs in articles:
        if chapter and chapter != last:
            out, last = out + f"## {chapter}\n\n", chapter
        out += f"### Article {k} — T{k}\n\n" + "".join("\n".join(p) + "\n\n" for p in paragraphs if p)
    return out


def test_many_documents(spark):
    docs = {}
    for d in range(70):
        docs[d] = [(k, f"CHAPTER {'AB'[k * d % 2]}", [[f"line {d} {k} {i} {j}" for j in range((d + i) % 3)] for i in range(k % 4)]) for k in range(1, 1 + d % 6)]
    rows = [(d, "<html><body>" + "".join(article(*a) for a in every) + "</body></html>") for d, every in docs.items()]
    made = spark.createDataFrame(rows, "celex long, xhtml string").repartition(3)
    parsed = L.parse_documents(made)
    titles = made.select("celex", F.lit("T").alias("title"), F.lit("D").alias("fetched"))
    written = L.to_markdown(parsed, titles)
    got = {r["celex"]: r["value"] for r in written.collect()}
    assert got.keys() == {d for d, every in docs.items() if every}
    for d, value in got.items():
        assert value.split("Articles only.\n\n", 1)[1] == expected(docs[d]).rstrip() + "\n", d
    plan = written._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # parsed once, written once
