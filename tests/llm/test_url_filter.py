from pyspark.sql import functions as F

from logsentinel.llm.url_filter import judge


def test_rules_and_reputation(spark):
    pages, outcomes = [], []
    for i in range(40):
        pages.append((i, f"http://good.shop.org/en/{i}"))
        outcomes.append((i, 1))
        pages.append((100 + i, f"http://bad.spam.org/en/{i}"))
        outcomes.append((100 + i, 0))
    pages += [(200, "HTTP://A.Example.COM/en/7?x#y"), (201, "x://example.com/en/8"), (202, "x://notexample.com/de/1"), (203, None), (204, "no scheme"), (205, "x://q.net/de/9"), (206, "x://a.example.net/de/81"),
              (207, "x://new.good.shop.org?/en/"), (208, "x://mail.spam.org/fr/1"), (209, "a://b.org://c/es/"), (200, "HTTP://A.Example.COM/en/7?x#y"), (210, "x://org/es/"), (211, "x://HOST.co.uk#f")]
    p = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1))
    o = spark.createDataFrame(outcomes + [(300, None)], "page_id long, good int")
    got = {r.page_id: r for r in judge(p, o).collect()}
    assert judge(p, o).count() == len(pages)
    assert (got[200].host, got[200].path, got[200].rule, got[200].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (got[201].rule, got[201].verdict) == ("com/en/", "block")
    assert got[202].rule is None
    assert (got[203].host, got[203].path) == ("", "") == (got[204].host, got[204].path)
    assert (got[205].rule, got[205].verdict) == ("net/de/", "allow")
    assert (got[206].rule, got[206].verdict) == ("example.net/de/8", "block")
    assert (got[207].host, got[207].path, got[207].rule) == ("new.good.shop.org", "", None)
    assert (got[209].host, got[209].path) == ("b.org:", "//c/es/")
    assert got[210].rule == "org/es/" and got[211].host == "host.co.uk"
    assert got[0].verdict == "allow" and got[100].verdict == "block"
    assert got[207].posterior_bound > got[208].posterior_bound  # domains pass on what their hosts have earned
    assert judge(p.limit(0), o).count() == 0 and judge(p, o.limit(0)).count() == len(pages)


def test_suffixes(spark):
    from logsentinel.llm.url_filter import domain_parts

    want = {"a.b.example.co.uk": ("example.co.uk", "co.uk"), "example.com": ("example.com", "com"), "x.example.com": ("example.com", "com"), "co.uk": ("co.uk", "uk"), "localhost": ("localhost", "localhost"), "": ("", ""), "s.gov.za": ("s.gov.za", "gov.za"), "a.com.example.de": ("example.de", "de")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    d, s = domain_parts(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", d.alias("d"), s.alias("s")).collect()} == want
