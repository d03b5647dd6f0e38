import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregate, display, graph, joins, reshape, rows, scrape, search, text
from tablewright.operators.order import numbered
from tablewright.plans import pipeline


def table(spark, schema, *cells):
    return spark.createDataFrame(list(cells), schema)


def got(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def groups(spark):
    return table(spark, "r int, id string, a long, b long", (0, "x", 1, 2), (1, "y", 2, 3), (2, "z", 3, 4), (3, "y", 1, 2), (4, "z", 2, 3), (5, "z", 3, 6))


def test_groupby_first_seen_order(groups):
    out = aggregate.groupby(groups, "id", "sum(a) as s, count() as n, first(b) as f, values(b) as v", order_by="r")
    assert got(out) == [("x", 1, 1, 2, "2"), ("y", 3, 2, 3, "3|2"), ("z", 8, 3, 4, "4|3|6")]
    assert got(aggregate.groupby(groups, "id", "max(a) / count() as m", keep="b", totals=True, order_by="r"))[2] == ("z", 4, 1.0, 0.5)


def test_aggregates(spark):
    n = table(spark, "r int, n long, c string", (0, 1, "red"), (1, 2, "blue"), (2, 3, "yellow"), (3, 4, "red"), (4, None, ""))
    clauses = {
        "sum(n)": 10, "mean(n)": 2.5, "median(n)": 2.5, "median_low(n)": 2, "median_high(n)": 3, "var(n)": 1.25, "q1(n)": 1.75, "quantile(n, 0.5)": 2.5, "mode(c)": "red", "modes(c)": "red", "cardinality(c)": 3, "most_common(2, c)": "red|blue", "most_common_counts(2, c)": "2|1",
        "distinct_values(c)": "blue|red|yellow", "first(c)": "red", "last(c)": "red", "last(n)": 4, "top(2, n)": "4|3", "argmax(n, c)": "red", "argmin(n)": 0, "argtop(2, n, c)": "red|yellow", "count(n > 2)": 2, "ratio(n > 2)": 0.4, "percentage(n > 2)": "40%", "all(n)": False, "any(n)": True, "lex_first(c)": "blue", "lex_last(c)": "yellow",
        "type(n)": "int", "types(c)": "string|empty", "rms(n)": math.sqrt(7.5), "count()": 5, "var_sample(n)": 5 / 3, "min(n) + max(n)": 5, "values(c, '&')": "red&blue&yellow&red",
    }
    row = aggregate.agg(n, ", ".join(f"{c} as c{i}" for i, c in enumerate(clauses)), order_by="r").first()
    for i, (clause, want) in enumerate(clauses.items()):
        assert row[i] == want or isinstance(want, float) and math.isclose(row[i], want), clause
    assert len(aggregate.agg(n, "dist(n) as d").first()[0]) == 10
    empty = aggregate.agg(n.limit(0), "sum(n) as s, mean(n) as m, count() as c, quantile(n, 0.5) as q, mode(c) as o", order_by="r").first()
    assert tuple(empty) == (0, None, 0, None, None)


def test_types(spark):
    t = table(spark, "I string, E string, M string, F string", ("1", "", "test", "2"), ("2", "", "1", "5.6"), ("5", "", "", "3"))
    assert tuple(aggregate.agg(t, "type(I) as i, type(E) as e, type(M) as m, type(F) as f, types(F) as fs").first()) == ("int", "empty", "mixed", "float", "float|int")


def test_count_years(spark):
    t = table(spark, "d string", ("2020-02-01",), ("2022-02-01",), ("2023-02-01",))
    assert aggregate.agg(t, "count_years(d) as y, count_days(d) as d").first()[:] == (3.0, 1096.0)


def test_windows(spark):
    n = table(spark, "n long", *[(i,) for i in range(1, 6)])
    out = aggregate.window(n, "lag(n) as a, lead(n, 2, 0) as b, cumsum(n) as c, rolling_sum(2, n) as d, mean(n) as m, row_index() as i", "n")
    assert got(out.orderBy("n")) == [(1, None, 3, 1, None, 3.0, 0), (2, 1, 4, 3, 3, 3.0, 1), (3, 2, 5, 6, 5, 3.0, 2), (4, 3, 0, 10, 7, 3.0, 3), (5, 4, 0, 15, 9, 3.0, 4)]
    r = table(spark, "r int, id int, n double", *[(i, *x) for i, x in enumerate([(1, -0.5), (1, -0.5), (1, -0.2), (1, 1.0), (1, 0.5), (2, -0.3), (2, -0.2), (2, 0.6), (2, -0.5), (2, -0.2)])])
    ranks = got(aggregate.window(r, "cume_dist(n) as c, ntile(2, n) as t, percent_rank(n) as p, rank(n) as k, front_coding(fmt('{}', n)) as f", "r", "id").orderBy("r"))
    assert [x[3:6] for x in ranks] == [(0.4, 1, 0.0), (0.4, 1, 0.0), (0.6, 1, 0.5), (1.0, 2, 1.0), (0.8, 2, 0.75), (0.4, 1, 0.25), (0.8, 1, 0.5), (1.0, 2, 1.0), (0.2, 1, 0.0), (0.8, 2, 0.5)]
    assert [x[6] for x in ranks][:5] == [1, 2, 3, 5, 4] and ranks[0][7] == "0 -0.5" and ranks[1][7] == "4 "
    over = table(spark, "name string, color string, age long", ("john", "red", 45), ("lucy", "yellow", 36))
    assert got(aggregate.window(over, "mean(age) as age, lag(color) as prev", "name", overwrite=True).orderBy("name")) == [("john", "red", 40.5, None), ("lucy", "yellow", 40.5, "red")]


def test_frequency(spark):
    t = table(spark, "h1 string, h2 string", ("a", "z"), ("a", "y"), ("a", "y"), ("b", "z"), ("", "z"), (None, "x"))
    assert sorted(got(aggregate.frequency(t, limit=2))) == [("h1", "<empty>", 2), ("h1", "<rest>", 1), ("h1", "a", 3), ("h2", "<rest>", 1), ("h2", "y", 2), ("h2", "z", 3)]
    ties = table(spark, "a string", *[(x,) for x in "xxyyzz"])
    assert got(aggregate.frequency(ties, "a", 2, no_extra=True)) == [("a", "x", 2), ("a", "y", 2)]
    assert sorted(got(aggregate.frequency(table(spark, "s string", ("a|b",), ("b",)), sep="|"))) == [("s", "a", 1), ("s", "b", 2)]


def test_joins(spark):
    cities = table(spark, "city string, state string", ("Boston", "MA"), ("New York", "NY"), ("San Francisco", "CA"), ("Buffalo", "NY"), ("", "??"))
    places = table(spark, "city string, place string", ("Boston", "Logan Airport"), ("Boston", "Boston Garden"), ("Buffalo", "Ralph Wilson Stadium"), ("Orlando", "Disney World"), ("", "nowhere"))
    assert sorted(got(joins.join(cities, places, "city"))) == [("Boston", "MA", "Boston Garden"), ("Boston", "MA", "Logan Airport"), ("Buffalo", "NY", "Ralph Wilson Stadium")]
    assert joins.join(cities, places, "city", "left").count() == 6 and joins.join(cities, places, "city", "right").columns == ["state", "city", "place"]
    full = joins.join(cities, places, "city", "full", left_prefix="l_", right_prefix="r_")
    assert full.columns == ["l_city", "l_state", "r_city", "r_place"] and full.count() == 8
    assert sorted(got(joins.join(cities, places, "city", "semi").select("city"))) == [("Boston",), ("Buffalo",)]
    assert sorted(got(joins.join(cities, places, "city", "anti").select("city"))) == [("",), ("New York",), ("San Francisco",)]
    assert joins.join(cities, places, "city", nulls=True).count() == 4
    assert joins.join(cities.select(F.upper("city").alias("city")), places, "city", fold=True).count() == 3
    assert got(joins.fuzzy(places, "place", table(spark, "p string", ("^Dis",), ("n$",)), "p", "regex").select("city", "p"))[-1] == ("Orlando", "^Dis")


def test_rows(spark):
    n = table(spark, "n long, s string", *[(i, f"v{i % 3}") for i in range(200)])
    shuffled = n.repartition(5, "s")
    assert got(numbered(shuffled, "n").orderBy("n").select("_row")) == [(i,) for i in range(200)]
    assert [r[0] for r in got(rows.slice_rows(shuffled, "n", start=10, length=3).orderBy("n"))] == [10, 11, 12]
    assert [r[0] for r in got(rows.slice_rows(shuffled, "n", indices=[0, 199]).orderBy("n"))] == [0, 199]
    assert [r[0] for r in got(rows.slice_rows(shuffled, "n", start_when="n > 5 and n % 2 == 0", end_when="n == 9").orderBy("n"))] == [6, 7, 8]
    assert [r[0] for r in got(rows.tail(shuffled, "n", 2))] == [198, 199] and got(rows.head(n, "n", 1)) == [(0, "v0")]
    assert sorted(r[0] for r in got(rows.filter_rows(n, "row_index() == 3", before=1, after=1, order_by="n"))) == [2, 3, 4]
    mixed = table(spark, "N string, S string", ("10", "a"), ("LETTER", "b"), ("2", "c"), ("1", "d"))
    assert [r[0] for r in got(rows.sort(mixed, "N", numeric=True))] == ["LETTER", "1", "2", "10"]
    ages = table(spark, "name string, age long", ("Sven", 34), ("Harold", 12), ("Mary", 29), ("Ann", 29))
    assert got(rows.top(ages, "age", 2, "name", rank="rank", ties=True).orderBy("rank", "name")) == [(1, "Sven", 34), (2, "Ann", 29), (2, "Mary", 29)]
    pairs = table(spark, "r int, a int, b int", (0, 1, 1), (1, 2, 2), (2, 2, 2), (3, 1, 1))
    assert sorted(got(rows.dedup(pairs, "a,b", "r"))) == [(0, 1, 1), (1, 2, 2)] and sorted(got(rows.dedup(pairs, "a,b", "r", last=True))) == [(2, 2, 2), (3, 1, 1)]
    assert sorted(got(rows.dedup(pairs, "a", "r", choose="new_r == 2").select("r"))) == [(0,), (2,)]
    assert got(rows.map_columns(ages, "age + 1 as next, name[0:1] as i").where("name = 'Sven'")) == [("Sven", 34, 35, "S")]
    assert got(rows.transform(ages, "name", "upper(_)").limit(1)) == [("SVEN", 34)]
    assert rows.rename(table(spark, "`A b` int", (1,)), slugify=True).columns == ["a_b"]
    assert rows.sample(n, 7, 1).count() == 7 and rows.evaluate(spark, "1 + 2") == 3
    gaps = table(spark, "r int, v string", (0, "a"), (1, ""), (2, None), (3, "b"))
    assert [r[1] for r in got(rows.fill(gaps, "v", order_by="r").orderBy("r"))] == ["a", "a", "a", "b"]
    assert [r[1] for r in got(rows.blank(table(spark, "r int, v string", (0, "a"), (1, "a"), (2, "b")), "r", "v").orderBy("r"))] == ["a", "", "b"]


def test_shapes(spark):
    colors = table(spark, "r int, name string, colors string", (0, "Mary", "yellow"), (1, "John", "blue|orange"), (2, "Jack", ""))
    long = reshape.explode(colors, "colors")
    assert sorted(got(long)) == [(0, "Mary", "yellow"), (1, "John", "blue"), (1, "John", "orange"), (2, "Jack", "")]
    seq = table(spark, "r int, name string, color string", (0, "Mary", "yellow"), (1, "John", "blue"), (2, "John", "orange"), (3, "Jack", ""), (4, "John", "red"))
    assert sorted(got(reshape.implode(seq, "color", "r"))) == [("Jack", ""), ("John", "blue|orange"), ("John", "red"), ("Mary", "yellow")]
    loc = table(spark, "id int, locution string", (0, "a priori"), (1, "de   facto"), (2, ""), (3, "au cas   où"), (5, "ex-æquo"))
    cut = reshape.separate(loc, "locution", " ").orderBy("id")
    assert cut.columns == ["id", *[f"locution{i}" for i in range(1, 6)]] and got(cut)[1] == (1, "de", "", "", "facto", "") and got(cut)[3] == (3, "au", "cas", "", "", "où")
    people = table(spark, "fullname string", ("John Doe",))
    assert got(reshape.separate(people, "fullname", captures=r"(?P<first>\w+) (?P<last>\w+)").select("first", "last")) == [("John", "Doe")]
    assert got(reshape.separate(people, "fullname", widths=[2, 3])) == [("Jo", "hn ")]
    assert got(reshape.separate(people, "fullname", match="[A-Z]")) == [("J", "D")]
    with pytest.raises(Exception, match="more than 1 parts"):
        reshape.separate(people, "fullname", " ", most=1).collect()
    gaps = table(spark, "id long, name string", (0, "alice"), (2, "bob"), (3, "charlie"), (7, "dave"))
    assert got(reshape.complete(gaps, "id").orderBy("id"))[1:3] == [(1, None), (2, "bob")] and reshape.missing(gaps, "id").count() == 4
    dates = table(spark, "date string, event string", ("2025-01", "e1"), ("2025-03", "e2"))
    assert got(reshape.complete(dates, "date", unit="month").orderBy("date")) == [("2025-01", "e1"), ("2025-02", None), ("2025-03", "e2")]
    months = table(spark, "dept string, jan int, feb int", ("electronics", 1, 2), ("clothes", 10, 20))
    flat = reshape.unpivot(months, "jan,feb", "month", "sales")
    assert sorted(got(flat))[0] == ("clothes", "feb", 20)
    wide = reshape.pivot(flat, "month", "sum(sales)", group="dept")
    assert sorted(got(wide)) == [("clothes", 20, 10), ("electronics", 2, 1)]
    merged = reshape.merge(table(spark, "name string", ("bautista",), ("caroline",)), table(spark, "name string", ("anna",), ("caroline",)), key="name", unique=True)
    assert got(merged) == [("anna",), ("bautista",), ("caroline",)]
    assert reshape.cat_rows(people, table(spark, "other int", (1,)), how="union").count() == 2
    with pytest.raises(ValueError):
        reshape.cat_rows(people, gaps)


def test_search(spark):
    t = table(spark, "h1 string, h2 string", ("foobar", "barfoo"), ("a", "b"), ("barfoo", "foobar"), ("", "FOOBAR"))
    assert search.search(t, "^foo", mode="regex").count() == 2 and search.search(t, "^foo", "h2", "regex").count() == 1 and search.search(t, "foobar", mode="exact", fold=True).count() == 3
    assert got(search.search(t, "foo", invert=True, fold=True)) == [("a", "b")] and search.search(t, mode="empty").count() == 1 and search.search(t, mode="nonempty", every=True).count() == 3
    assert search.search(t, "fobar", mode="levenshtein").count() == 2 and search.search(t, "ofobar", mode="damerau").count() == 2 and search.search(t, "foobar", mode="levenshtein", distance=0).count() == 2
    words = table(spark, "text string", ("le chien mange le fromage",), ("la souris mange",), ("rien",))
    assert got(search.breakdown(words, [("LE", "le"), ("LA", "la")])) == [("le chien mange le fromage", 2, 0), ("la souris mange", 0, 1)]
    assert got(search.count_matches(table(spark, "s string", ("aaa",)), "aa", overlapping=True)) == [("aaa", 2)]
    assert got(search.unique_matches(words, [("b", "mange"), ("a", "chien")])) == [("le chien mange le fromage", "a|b"), ("la souris mange", "b")]
    assert got(search.replace(words, [("l([ea])", "L$1")], mode="regex"))[0] == ("Le chien mange Le fromage",)


def test_texts(spark):
    t = table(spark, "n int, text string", (1, "le chat mange"), (2, "la souris"), (3, ""))
    assert got(text.tokenize(t, "text", ngrams=(1, 2)).orderBy("n")) == [(1, "le le§chat chat chat§mange mange"), (2, "la la§souris souris"), (3, "")]
    assert text.tokenize(t, "text", "token", rows=True).count() == 5
    assert got(text.tokenize(table(spark, "text string", ("aujourd'hui",)), "text", simple=True)) == [("aujourd hui",)]
    kinds = text.tokenize(table(spark, "text string", ("1 chat #tag @me a@b.fr http://x.y/z !",)), "text", "token", rows=True, types="kind")
    assert [r[1] for r in got(kinds)] == ["number", "word", "hashtag", "mention", "email", "url", "punct"]
    d = table(spark, "doc int, token string", (1, "cat"), (1, "dog"), (1, "cat"), (2, "cat"), (2, "rabbit"))
    want = [(1, "cat", 2.0, 1.8, 0.0, 0.0, 0.13888888888888884), (1, "dog", 1.0, 0.6, 0.6931471805599453, 0.64072428455121, 0.8333333333333334), (2, "cat", 1.0, 1.2, 0.0, 0.0, None), (2, "rabbit", 1.0, 0.4, 0.6931471805599453, 0.7549127709068711, 1.875)]
    for a, b in zip(sorted(got(text.vocab_doc_token(d, "doc", "token"))), want, strict=True):
        assert a[:2] == b[:2] and all(x is y is None or math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a[2:], b[2:], strict=True))
    bag = table(spark, "doc int, tokens string", (1, "cat|dog|cat"), (2, "cat|rabbit"))
    pairs = {r.token1 + r.token2: r for r in text.cooccurrences(bag, "doc", "tokens", "doc", sep="|").collect()}
    assert {k: r["count"] for k, r in pairs.items()} == {"catdog": 2, "catrabbit": 1}
    assert [r[1] for r in got(text.sentences(table(spark, "n int, t string", (1, "One. Two! Three?")), "t"))] == ["One.", "Two!", "Three?"]


def test_graphs(spark):
    e = graph.edge_list(table(spark, "source string, target string", ("A", "B"), ("B", "C"), ("B", "C"), ("X", "Y"), ("Z", "Z")), "source", "target")
    assert sorted(got(graph.nodes(e, component=True))) == [("A", "A"), ("B", "A"), ("C", "A"), ("X", "X"), ("Y", "X"), ("Z", "Z")]
    assert got(graph.component_sizes(e)) == [(3, "A"), (2, "X"), (1, "Z")]
    s = graph.statistics(e).first()
    assert (s.nodes, s.edges, s.is_multi, s.has_self_loops, s.connected_components) == (6, 4, True, True, 3) and math.isclose(s.density, 4 / 30)
    chain = graph.edge_list(table(spark, "a string, b string", *[(f"{i:03}", f"{i + 1:03}") for i in range(40)]), "a", "b")
    assert got(graph.component_sizes(chain)) == [(41, "000")]
    assert '"A"' in graph.to_json(e) and "<gexf" in graph.to_gexf(e)
    m = aggregate.adjacency(e, "source", "target", "weight")
    assert m.columns == ["node", "A", "B", "C", "X", "Y", "Z"] and got(m)[1][:4] == ("B", None, None, 2)


def test_scraping(spark):
    html = "<html lang=en><head><title> One </title><link rel='canonical' href='http://c'></head><body><ul class='l big'><li id=a>x<li>y <b>z</b></ul><a href='/u?a=1'>go</a><script>'<a href=no>'</script><script type='application/ld+json'>{\"@type\": \"NewsArticle\", \"headline\": \"H\"}</script></body></html>"
    t = table(spark, "n int, html string", (1, html), (2, None))
    assert got(scrape.head(t, "html")) == [(1, "One", "http://c"), (2, "", "")]
    assert got(scrape.urls(t, "html", "http://b/")) == [(1, "http://b/u?a=1")]
    assert got(scrape.article(t, "html").select("n", "headline", "canonical_url")) == [(1, "H", "http://c"), (2, "", "")]
    out = scrape.scrape(t, "html", "id: 'ul > li:first-child'.id(); all: all('li').text(); cls: 'ul'.classes(); next: '#a'.next_sibling().text()")
    assert got(out)[0] == (1, "a", "x|y z", "l big", "y z")
    assert [r[1] for r in got(scrape.scrape(t, "html", "t: text()", foreach="li"))] == ["x", "y z"]


def test_stats_and_bins(spark):
    t = table(spark, "n string, s string", ("1", "é"), ("2", ""), ("", "abc"), ("4", None))
    s = {r.field: r for r in aggregate.stats(t, quartiles=True, cardinality=True).collect()}
    assert (s["n"]["count"], s["n"].count_empty, s["n"].type, s["n"].sum, s["n"].q1) == (3, 1, "int", 7.0, 1.5) and (s["s"].max_length, s["s"].lex_first, s["s"].mean) == (3, "abc", None)
    n = table(spark, "n double", *[(float(i),) for i in range(11)])
    assert sorted((r.lower_bound, r["count"]) for r in aggregate.bins(n, goal=5, exact=True).collect()) == [(0.0, 2), (2.0, 2), (4.0, 2), (6.0, 2), (8.0, 3)]
    assert aggregate.nice_ticks(0, 97, 10) == (0, 10, 10)


def test_pipelines(spark, groups):
    out = pipeline.run(groups, "filter 'a > 1' | groupby id 'sum(b) as s' | sort s --numeric --reverse", order_by="r")
    assert got(out.select("id", "s")) == [("z", 13), ("y", 3)]
    t = pipeline.Table(groups, "r").filter("b > 2").top("b", 1)
    assert got(t.df) == [(5, "z", 3, 6)]


def test_order_does_not_depend_on_partitions(spark, groups):
    for n in (1, 3, 7):
        again = groups.repartition(n, "b")
        assert got(aggregate.groupby(again, "id", "values(b) as v", order_by="r")) == [("x", "2"), ("y", "3|2"), ("z", "4|3|6")]


def test_checks_and_displays(spark, groups):
    assert rows.headers(groups, groups.select("b", "id")) == [("r", [0]), ("id", [0, 1]), ("a", [0]), ("b", [0, 1])]
    assert rows.is_sorted(groups, "r", "r") and not rows.is_sorted(groups, "a", "r") and rows.is_unique(groups, "r") and not rows.is_unique(groups, "a")
    n = table(spark, "n long", *[(i,) for i in range(500)])
    assert rows.is_sorted(n, "n", "n") and not rows.is_sorted(n.withColumn("m", F.when(F.col("n") == 250, 0).otherwise(F.col("n"))), "m", "n")
    assert "█" in display.hist(aggregate.frequency(groups, "id")) and "│ id" in display.view(groups)
    line = display.regression(table(spark, "x double, y double", (0.0, 1.0), (1.0, 3.0), (2.0, 5.0)), "x", "y").first()
    assert math.isclose(line.slope, 2) and math.isclose(line.intercept, 1)
