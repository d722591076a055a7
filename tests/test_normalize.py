from jobsight.functions import text as T
from jobsight.functions.similarity import ratio_py


def norm(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn("v").alias("o")).orderBy("i").collect()]


def test_title_fixtures(spark):
    vals = ["Sr. Software Engineer", "Sr SWE", "Sr. Engineer", "Jr. Software Engineer", "Jr Engineer",
            "Senior SWE", "  software engineer  ", "Software    Engineer", "Software Engineer (Remote)",
            "", None, "Sr. SWE - ML", "Sr.Engineer", "women's 3d-artist", "DevOps Eng", "QA/QC Lead"]
    out = norm(spark, T.normalize_title, vals)
    assert "Senior" in out[0] and "Senior" in out[1] and "Senior" in out[2]
    assert "Junior" in out[3] and "Junior" in out[4]
    assert "Software Engineer" in out[5]
    assert out[6] == "Software Engineer" and out[7] == "Software Engineer"
    assert "Remote" in out[8]
    assert out[9] == "" and out[10] == ""
    assert out[11] == "Senior Software Engineer - Machine Learning"
    assert out[12] == "SeniorEngineer"


def test_location_fixtures(spark):
    vals = ["NYC", "New York City", "New York, NY", "SF", "San Francisco, CA", "LA", "Los Angeles, CA",
            "Chicago, IL", "Seattle, WA", "Work from Home", "New Orleans, LA", "chi-town", None, "  "]
    out = norm(spark, T.normalize_location, vals)
    assert all("New York" in o for o in out[:3])
    assert "San Francisco" in out[3] and "San Francisco" in out[4]
    assert "Los Angeles" in out[5]
    assert out[8] == "Seattle, Washington" and out[9] == "Remote"
    assert out[10] == "New Orleans, Los Angeles" and out[11] == "Chicago-town"
    assert out[12] == "" and out[13] == ""


def test_company_and_seniority(spark):
    vals = ["Acme Corp.", "Acme Co Inc", "TechCorp", "  big   data llc", None]
    out = norm(spark, T.normalize_company, vals)
    assert out[:3] == ["Acme", "Acme Co", "Techcorp"]
    assert out[4] == ""
    lv = norm(spark, T.seniority_level, ["International Lead", "Sr. Engineer", "Senior Vice President",
                                          "staff engineer"])
    assert lv == [0, None, 13, 6]


def test_key_terms_and_similarity(spark):
    vals = ["Senior Software Engineer", "Software Engineer", "The Lead Data Scientist of ML", ""]
    out = norm(spark, T.key_terms, vals)
    assert out[0] == out[1] == ["engineer", "software"]
    assert "the" not in out[2] and "lead" not in out[2] and out[3] == []
    assert ratio_py("Software Engineer", "Software Engineer") == 1.0
    assert ratio_py("Software Engineer", "Data Scientist") < 0.5
    assert ratio_py("Software Engineer", "Software Engineering") > 0.8
    assert ratio_py("tide", "diet") != ratio_py("diet", "tide")


def test_plain_texts_agree_with_the_rules(spark):
    """The one-pass helpers against the Catalyst rules, and null for what is not plain."""
    import random

    from pyspark.sql import functions as F

    from jobsight.functions import plain_text as P
    rnd = random.Random(5)
    parts = ["sr", "Sr.", "dev.", "VP", "evp", "IT", "be", "em", "api", "qa/qc", "entry level", "c-level", "3dev", "_it", "o'it",
             "executive vice president", "senior vice  president", "intern", "in.tern", "mid", "straße", "ßa", "l'été", "\t",
             "\xa0", "(be)", "Sr.Dev", "Dev.Sr", "Eng.It", "dev.vp", "«it»", "×a"]
    texts = ["".join(rnd.choice(parts) + rnd.choice([" ", " ", "", "-", ".", "  "]) for _ in range(rnd.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T._title_by_rules(F.col("t")).alias("n"), T._terms_by_rules(F.col("t")).alias("k")).collect()
    for r in rows:
        assert P.plain_title_py(r["t"]) == r["n"], r["t"]
        assert P.plain_terms_py(r["t"]) == r["k"], r["t"]
    for t in ("\x1cit", "m²", "µm", "日本", "ÿ", "opſ", None):
        assert P.plain_title_py(t) is None and P.plain_terms_py(t) is None
