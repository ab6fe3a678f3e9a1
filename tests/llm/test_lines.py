from drawlytics.llm import lines


def test_boilerplate_goes_and_copies_stay(spark):
    pages = [(i, f"nav bar\n\n  \nown {i}", "h") for i in range(10)] + [(100 + i, "whole copy\nof a page", "h") for i in range(6)]
    pages += [(200, "nav bar\nown", "small"), (201, None, "h"), (202, "", None)]
    out = {r["doc_id"]: r for r in lines.drop_boilerplate(spark.createDataFrame(pages, "doc_id long, text string, source string"), counts=True).collect()}
    assert out[3]["text"] == "\n  \nown 3" and (out[3]["n_lines"], out[3]["n_dropped"]) == (2, 1)
    # Every line of a copied page is frequent, so the page stays whole.
    assert out[100]["text"] == "whole copy\nof a page" and out[100]["n_dropped"] == 0
    # A small host has its own counts.
    assert out[200]["text"] == "nav bar\nown"
    assert out[201]["text"] is None and out[202]["text"] == ""


def test_a_line_twice_on_a_page_counts_once(spark):
    pages = [(i, "twice\ntwice\nrest %d" % i, "h") for i in range(4)] + [(9 + i, f"p{i}", "h") for i in range(40)]
    out = lines.drop_boilerplate(spark.createDataFrame(pages, "doc_id long, text string, source string"), counts=True)
    assert out.where("n_dropped > 0").count() == 0


def test_odd_rows(odd, none):
    out = lines.drop_boilerplate(odd, min_pages=1, ratio=0.9)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert lines.drop_boilerplate(none).count() == 0
