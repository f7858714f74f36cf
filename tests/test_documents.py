"""Labels, matching, assembly, graphics, XML and training data."""

import xml.etree.ElementTree as ET
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quire.operators import features, graphics, jats, labels, match, semantic, tei, training, whole
from quire.plans import document, texts
from quire.sources import files, layout, sinks
from quire.streaming import documents as streams

SPAN = "doc_id INT, span_no INT, tag STRING, text STRING, n_tokens INT"


def tokens(spark, text, doc_id=1):
    return layout.text_layout(spark.createDataFrame([(doc_id, text)], "doc_id INT, text STRING"))


def labelled(spark, rows):
    return spark.createDataFrame([(1, i // 5, i % 5, t, " ", None, None, lab) for i, (t, lab) in enumerate(rows)],
                                 f"doc_id INT, line_no INT, token_no INT, text STRING, whitespace STRING, font {layout.FONT}, coord {layout.COORD}, label STRING")


def brute_islands(tags):
    out, before, start = [], "O", 0
    for i, t in enumerate(tags):
        prefix, _, tag = t.partition("-") if "-" in t else ("", "", t)
        if prefix == "B" or tag != before:
            if start < i:
                out.append((before, start, i - 1))
            before, start = tag, i
    return [*out, (before, start, len(tags) - 1)]


def test_islands_against_a_loop(spark):
    import random

    rng = random.Random(4)
    seqs = [[rng.choice(["O", "B-a", "I-a", "B-b", "I-b", "c"]) for _ in range(rng.randrange(1, 15))] for _ in range(60)]
    rows = [(d, i, t) for d, s in enumerate(seqs) for i, t in enumerate(s)]
    df = labels.with_islands(spark.createDataFrame(rows, "doc_id INT, i INT, label STRING"), order=("i",))
    got = df.groupBy("doc_id", "span_no", "tag").agg(F.min("i").alias("a"), F.max("i").alias("b")).orderBy("doc_id", "span_no").collect()
    for d, s in enumerate(seqs):
        assert [(r.tag, r.a, r.b) for r in got if r.doc_id == d] == brute_islands(s), s


def test_spans_filters_and_output(spark):
    df = labelled(spark, [("A", "B-<x>"), ("b", "I-<x>"), (".", "O"), ("C", "B-<x>")])
    assert [(r.tag, r.text) for r in labels.spans(df).orderBy("span_no").collect()] == [("<x>", "A b"), ("O", "."), ("<x>", "C")]
    assert labels.filtered(df, ["<x>"]).count() == 3
    out = labels.model_output(df, "json").first().output
    assert out.startswith('[{"token":"A","label":"B-<x>"}')
    assert labels.model_output(df, "data").first().output == "A B-<x>\nb I-<x>\n. O\nC B-<x>"
    with pytest.raises(Exception, match="no label"):
        labels.zipped(df.drop("label"), df.where("token_no < 2")).collect()


def test_models_plug_in(spark):
    t = tokens(spark, "One two\nThree")
    lines = features.feature_lines(t, "name")
    assert lines.count() == 3 and lines.first().data.split(" ")[0] in ("One", "two", "Three")
    found = labels.with_model_labels(lines, lambda data: [f"I-<{d.split(' ')[1]}>" for d in data])
    assert sorted(r.label for r in found.collect()) == ["I-<one>", "I-<three>", "I-<two>"]
    for model, n in (("affiliation_address", 22), ("citation", 30), ("fulltext", 27), ("header", 32), ("name", 21), ("reference_segmenter", 28)):
        assert len(features.MODEL_FEATURES[model]) == n
    assert len(features.SEGMENTATION_FEATURES) == 34


def test_repetitive_first_lines(spark):
    page = "\n".join(["Running header text", *["body line with words"] * 39])
    rows = features.repetitions(features.lines(tokens(spark, f"{page}\n{page.replace('body', 'other')}"))).where("repetitive = '1'").orderBy("line_no").collect()
    assert [(r.line_no, r.first_repetitive) for r in rows if r.text.startswith("Running")] == [(0, "1"), (40, "0")]


def test_partial_match_takes_the_first_seen(spark):
    targets = spark.createDataFrame([("d", "b0", 0, "Smith 1999"), ("d", "b1", 1, "Jones 2001 2001")], "doc_id STRING, target_id STRING, ord INT, text STRING")
    cited = spark.createDataFrame([("d", 1, "Smith 2001"), ("d", 2, "Smith Jones"), ("d", 3, "x")], "doc_id STRING, citation_id INT, text STRING")
    got = {r.citation_id: r.target_id for r in match.match_by_tokens(cited, targets).collect()}
    assert got == {1: "b0", 2: None, 3: None}


def test_ids_of_hot_partitions(spark):
    rows = [(i * 7 % 501 if i else None, "hot" if i % 3 else None if i % 2 else "a") for i in range(501)]
    want, seen = {}, {}
    for i, p in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        want[i] = f"b{seen.setdefault(p, 0)}"
        seen[p] += 1
    df = spark.createDataFrame(rows, "i BIGINT, p STRING")
    for buckets in (1, 2, 16):
        assert {r.i: r.content_id for r in match.with_ids(df, "b", ["p"], ["i"], buckets=buckets).collect()} == want
    assert match.with_ids(df.limit(0), "b", ["p"], ["i"]).count() == 0


def test_names():
    split = lambda *parts: [[(k, v or t) for k, _, t, v in name] for name in semantic.split_names(list(parts))]
    assert split(("<forename>", "JOHN"), ("<surname>", "SMITH"), ("<forename>", "A"), ("<surname>", "B")) == [[("GivenName", "John"), ("Surname", "Smith")], [("GivenName", "A"), ("Surname", "B")]]
    assert split(("<surname>", "A"), ("<marker>", "1"), ("<surname>", "B")) == [[("Surname", "A"), ("Marker", "1")], [("Surname", "B")]]
    assert split(("<marker>", "1"), ("<surname>", "A"), ("O", ","), ("<marker>", "2"), ("<surname>", "B")) == [[("Marker", "1"), ("Surname", "A"), ("Note", ",")], [("Marker", "2"), ("Surname", "B")]]
    assert semantic.split_names([("<forename>", "X")])[0][0][:3] == ("Note", "invalid_author_name", "X")


def test_affiliations():
    kinds = lambda *parts: [[k for k, *_ in a] for a in semantic.split_affiliations(list(parts))]
    assert kinds(("<marker>", "1"), ("<institution>", "U"), ("<institution>", "V"), ("<country>", "F")) == [["Marker", "Institution"], ["Institution", "Country"]]
    assert semantic.split_affiliations([("<country>", "France..")])[0] == [("Country", None, "France", None), ("Note", "<country>-suffix", "..", None)]


def test_outermost_nodes(spark):
    nodes = spark.createDataFrame([(1, [0], "Section"), (1, [0, 0], "Figure"), (1, [0, 0, 1], "Figure"), (1, [1], "Figure")], "doc_id INT, path ARRAY<INT>, type STRING")
    assert sorted(r.path for r in semantic.outermost_of_type(nodes, ["Figure"]).collect()) == [[0, 0], [1]]


def test_matching_rounds():
    box = lambda y: [{"x": 0.0, "y": y, "w": 1.0, "h": 0.1}]
    found = graphics._matched([(0, box(1.0)), (1, box(0.8)), (2, box(5.0))], [(7, box(1.2))], 0.3)
    assert [(g, c) for g, c, _ in found] == [(0, 7), (1, 7)]


def test_tei_and_jats(spark):
    text = "\n".join(["A Title Here", "Jane Doe 1", "1 University of X France", "Abstract text of it", "more abstract"] + [f"Section {i} words go on 12 and on" for i in range(60)])
    row = document.converted(tokens(spark, text), "jats").first()
    root = ET.fromstring(row.tei)
    ns = {"t": tei.NAMESPACE}
    assert "".join(root.find(".//t:titleStmt/t:title", ns).itertext()) == "A Title Here"
    assert root.find(".//t:author/t:persName/t:surname", ns) is not None and root.findall(".//t:body/t:div/t:p", ns)
    article = ET.fromstring(row.jats)
    assert article.findtext("front/article-meta/title-group/article-title") == "A Title Here"
    assert article.find("body/sec/p") is not None and article.find("back/ref-list/ref") is not None
    only = ET.fromstring(document.convert(tokens(spark, text), includes=["title"]).first().tei)
    assert only.find(".//t:body/t:div", ns) is None and only.find(".//t:author", ns) is None
    title = spark.createDataFrame([(row.tei,)], "x STRING").select(tei.query(F.col("x"), "TEI/teiHeader/fileDesc/titleStmt/title")).first()[0]
    assert "".join(title) == "A Title Here"


def test_references_figures_and_graphics(spark):
    lines = ["A Title Here", "Jane Doe 1", "1 University of X France", "Abstract text", "more"] + [f"Figure {i} words go on 12 and on" for i in range(60)]
    t = tokens(spark, "\n".join(lines))
    box = {"x": 0.0, "y": 17.0, "w": 5.0, "h": 1.0, "page": 1}
    graphics_ = spark.createDataFrame([(1, 0, "bitmap", "a.png", [box], None), (1, 1, "bitmap", "b.png", [], "Figure 28"), (1, 2, "svg", "c.svg", [], "none")],
                                      f"doc_id INT, graphic_id BIGINT, graphic_type STRING, relative_path STRING, boxes ARRAY<{layout.COORD}>, text STRING")
    out = document.convert(t, graphics=graphics_)
    root, ns = ET.fromstring(out.first().tei), {"t": tei.NAMESPACE}
    figures = root.findall(".//t:body/t:figure", ns)
    assert [f.get("{http://www.w3.org/XML/1998/namespace}id") for f in figures] == ["fig_0", "fig_1", "tab_0", "tab_1", "tab_2"]
    assert figures[0].findtext("t:head", None, ns) == "Figure 11" and figures[0].find("t:figDesc", ns) is not None and figures[2].get("type") == "table"
    assert [g.get("url") for g in root.findall(".//t:graphic", ns)] == ["a.png", "b.png"]
    bibl = root.findall(".//t:listBibl/t:biblStruct", ns)
    assert bibl and bibl[0].find("t:analytic/t:title", ns) is not None and bibl[0].find("t:monogr/t:imprint/t:date", ns) is not None and bibl[0].find("t:note[@type='raw_reference']", ns) is not None
    assert all(f.is_cached for f in out._held)
    frames = list(out._held)
    document.release(out)
    assert frames and not any(f.is_cached for f in frames)


def test_a_tagger_gets_whole_documents(spark):
    import sys

    script = "import sys\nfor d in sys.stdin.read().rstrip('\\n').split('\\n\\n'):\n n = len(d.split('\\n'))\n print('\\n'.join(f'{x} L{n}' for x in d.split('\\n')) + '\\n')"
    rows = [(d, i // 10, i % 10, f"w{i}") for d, n in ((1, 25_000), (2, 3), (3, 12_000), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id INT, line_no INT, token_no INT, data STRING").repartition(1)
    for at_once in (100_000, 5_000):
        got = labels.with_process_labels(df, [sys.executable, "-c", script], lines_at_once=at_once).groupBy("doc_id", "label").count().collect()
        assert sorted(map(tuple, got)) == [(1, "L25000", 25_000), (2, "L3", 3), (3, "L12000", 12_000), (4, "L1", 1)]


def test_a_long_line(spark):
    t = tokens(spark, "ab, " * 500_000)
    found = features.positions(t).agg(F.count("*").alias("n"), F.max("line_position").alias("p"), F.max("line_chars").alias("c")).first()
    assert tuple(found) == (1_000_000, 9, 1_500_000)


def test_written_files_keep_their_newlines(spark, tmp_path):
    sinks.write_xml(spark.createDataFrame([(1, "<a>x\ny</a>"), (2, "<b/>")], "doc_id INT, tei STRING"), str(tmp_path / "out"))
    assert [p.read_text() for p in sorted((tmp_path / "out").glob("doc_id=*/part*"))] == ["<a>x\ny</a>\n", "<b/>\n"]


def test_each_name_is_an_element():
    rows = [(0, "Jane", " ", "B-<forename>"), (0, "Doe", "", "B-<surname>"), (0, ",", " ", "O"), (0, "John", " ", "B-<forename>"), (0, "Roe", "", "B-<surname>")]
    xml = training.encode(training.SPECS["name"], rows, training._name_rows(rows))
    assert xml.count("<persName>") == 2 and xml.count("<author>") == 1


TEI = f"""<TEI xmlns="{tei.NAMESPACE}"><teiHeader><fileDesc><titleStmt><title>T <hi rend="italic">i</hi></title></titleStmt><sourceDesc><biblStruct><analytic><author><persName><forename>A</forename><forename>B</forename><surname>C</surname></persName>
<affiliation key="aff0"><orgName type="institution">U</orgName><address><country>F</country></address></affiliation></author></analytic><monogr><title>J</title></monogr></biblStruct></sourceDesc></fileDesc></teiHeader><text><body><div><head n="1">H</head><p>see <ref type="bibr" target="#b0">1</ref> and <ref type="figure">2</ref></p><formula>x</formula></div>
<figure xml:id="fig_0"><head>Fig 1</head><figDesc>cap</figDesc></figure></body><back><div type="acknowledgement"><head>Thanks</head><p>all</p></div><div type="annex"><div><p>annexed</p></div></div><div type="references"><listBibl><biblStruct xml:id="b0"><analytic><title type="main">R</title><idno type="DOI">10.1/x</idno></analytic>
<monogr><imprint><date type="published" when="2001-02">2001</date><biblScope unit="page" from="1" to="2">1-2</biblScope></imprint></monogr></biblStruct></listBibl></div></back></text></TEI>"""


def test_jats_rules():
    a = ET.fromstring(jats.article(TEI))
    assert a.findtext(".//journal-title") == "J" and a.findtext(".//article-title") == "T i" and a.findtext(".//given-names") == "A B"
    assert a.find(".//contrib/xref").get("rid") == "aff0" and a.findtext(".//aff/country") == "F"
    p = a.find("body/sec/p")
    assert p.find("xref").get("rid") == "b0" and "".join(p.itertext()) == "see 1 and 2" and a.find("body/sec/formula") is None
    assert a.find("body/sec[@id='figures']/fig").get("id") == "fig_0" and a.find(".//fig/graphic") is not None
    ref = a.find("back/ref-list/ref")
    assert [ref.findtext(f".//{t}") for t in ("article-title", "year", "month", "fpage", "lpage", "pub-id")] == ["R", "2001", "02", "1", "2", "10.1/x"]
    assert a.findtext("back/ack/sec/title") == "Thanks" and a.findtext("back/sec/p") == "annexed"
    strict = ET.fromstring(jats.article(TEI, jats.JatsOptions(strict=True, annex="app", italic=True, empty_graphics=False, parameters=True)))
    assert strict.find("back/ack/sec") is None and strict.find(".//pub-id") is None and strict.find(".//fig/graphic") is None
    assert strict.findtext("back/app-group/app/sec/p") == "annexed" and strict.findtext(".//article-title/i") == "i" and len(strict.findall(".//custom-meta")) == 2


@pytest.mark.parametrize("model", [m for m in training.SPECS if m != "segmentation"])
def test_training_documents_round_trip(model):
    spec = training.SPECS[model]
    wanted = [lab for lab, path in spec.paths.items() if path and lab not in training.OUTSIDE]
    # Labels that share an element come back as one of them.
    same = {path: lab for lab, path in spec.paths.items()}
    rows, want = [], []
    for i, lab in enumerate(wanted):
        lab = same[spec.paths[lab]]
        rows += [(i, f"w{i}a", " ", f"B-{lab}"), (i, f"w{i}b", "\n", f"I-{lab}")]
        want += [(f"w{i}a", f"B-{lab}"), (f"w{i}b", f"I-{lab}")]
    got = [(t, lab) for part in training.decode(spec, training.encode(spec, rows)) for _, t, lab in part]
    assert [t for t, _ in got] == [t for t, _ in want]
    assert [lab.partition("-")[2] for _, lab in got] == [lab.partition("-")[2] for _, lab in want]


def test_training_forms():
    xml = training.encode(training.SPECS["header"], [(0, "A", " ", "B-<title>"), (0, "b", "\n", "I-<title>"), (1, "C&", " ", "B-<unknown>"), (1, "d", "\n", "O")])
    assert '<docTitle><titlePart>A b<lb/>' in xml and '<note type="unknown">C&amp;' in xml
    assert training.encode_lines(training.SPECS["segmentation"], [("x", "B-<header>"), ("y", "I-<header>"), ("z", "B-<body>")]) == "<tei><text><front>x<lb/>\ny<lb/></front>\n<body>z<lb/></body>\n</text></tei>"
    with pytest.raises(ValueError):
        training.decode(training.SPECS["name"], "<tei>" + "".join(f"<{x}>" for x in training.SPECS["name"].root) + "<odd>x</odd>" + "".join(f"</{x}>" for x in reversed(training.SPECS["name"].root)) + "</tei>")


def test_crf_alignment(spark):
    rows = spark.createDataFrame([(1, 0, "a", "B-<x>"), (1, 1, "b", "O")], "doc_id INT, token_no INT, token STRING, label STRING")
    data = spark.createDataFrame([(1, 0, "a", "a f1"), (1, 1, "b", "b f2")], "doc_id INT, token_no INT, token STRING, data STRING")
    assert training.crf_lines(rows, data).first().text == "a f1 I-<x>\nb f2 <other>"
    with pytest.raises(Exception, match="differ"):
        training.crf_lines(rows, data.where("token_no = 0")).collect()


ALTO = """<alto><Styles><TextStyle ID="f0" FONTFAMILY="times" FONTSIZE="9.5" FONTSTYLE="bold italics"/><TextStyle ID="f1" FONTFAMILY="arial" FONTSIZE="8" FONTSTYLE=""/></Styles><Layout><Page ID="P1" PHYSICAL_IMG_NR="1" WIDTH="100" HEIGHT="200"><PrintSpace>
<TextBlock ID="b1"><TextLine ID="l1"><String CONTENT="Hello" HPOS="1" VPOS="2" WIDTH="5" HEIGHT="1" STYLEREFS="f0"/><SP/><String CONTENT="wor" HPOS="7" VPOS="2" WIDTH="3" HEIGHT="1" STYLEREFS="f1"/><String CONTENT="ld" HPOS="10" VPOS="2" WIDTH="2" HEIGHT="1" STYLEREFS="f1"/></TextLine></TextBlock>
<Illustration ID="i1" TYPE="svg" FILEID="img/a.svg" HPOS="0" VPOS="0" WIDTH="10" HEIGHT="10"/></PrintSpace></Page></Layout></alto>"""


def test_alto(spark):
    df = spark.createDataFrame([(1, ALTO)], "doc_id INT, xml STRING")
    got = [(r.text, r.whitespace, r.font.family, r.font.bold, r.coord.x, r.token_count) for r in layout.alto_layout(df).orderBy("token_no").collect()]
    assert got == [("Hello", " ", "times", True, 1.0, 3), ("wor", "", "arial", False, 7.0, 3), ("ld", "\n", "arial", False, 10.0, 3)]
    assert graphics.graphic_rows(layout.alto_graphics(df), True).first().relative_path == "a.svg"
    assert tuple(layout.alto_pages(df).first()) == (1, 1, 100.0, 200.0)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("France\n\nSpain\n")
    (tmp_path / "b.xml").write_text("<TEI xmlns='x'><cell>Italy</cell><cell>Spain</cell></TEI>")
    terms = files.lexicon(spark, {"country": [str(tmp_path / "a.txt"), str(tmp_path / "b.xml")]})
    assert sorted(r.term for r in terms.collect()) == ["france", "italy", "spain"]
    flagged = features.lookups(tokens(spark, "in France or"), terms).where("is_country = '1'")
    assert [r.text for r in flagged.collect()] == ["France"]
    assert files.with_environment({"a": {"b": 1}}, {"QUIRE__A__B": "2", "QUIRE__C": "x", "OTHER": "1"}) == {"a": {"b": 2}, "c": "x"}
    assert files.accepted_media_type(["text/x", "*/*"], ["a", "b"]) == "a" and files.accepted_media_type(["b"], ["a", "b"]) == "b" and files.accepted_media_type(["c"], ["a"]) is None
    kinds = spark.createDataFrame([("a.pdf", None), ("a.docx", "application/octet-stream"), ("x", "text/plain"), ("x", "")], "f STRING, m STRING").select(files.media_type(F.col("f"), F.col("m")))
    assert [r[0] for r in kinds.collect()] == ["application/pdf", files.MEDIA_TYPES["docx"], "text/plain", "application/octet-stream"]
    assert len(files.files_or_fail(spark, str(tmp_path / "*.txt"))) == 1 and files.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "a.txt")]).endswith("a.txt")
    with pytest.raises(FileNotFoundError):
        files.files_or_fail(spark, str(tmp_path / "*.none"))


def test_archives(spark):
    docs = spark.createDataFrame([(1, "<TEI/>")], "doc_id INT, tei STRING")
    assets = spark.createDataFrame([(1, "a.png", bytearray(b"png"))], "doc_id INT, relative_path STRING, content BINARY")
    with zipfile.ZipFile(BytesIO(sinks.zipped_assets(docs, assets).first().archive)) as z:
        assert z.namelist() == ["document.xml", "a.png"] and z.read("a.png") == b"png"
    assert sinks.training_path("d", ".tei.xml", "x/y", True) == "x/y/d.tei.xml.gz"


def test_requested_fields():
    c = document.PlanConfig()
    assert c.for_fields([]) == c == c.for_fields(["title", "unknown"])
    title = c.for_fields(["title"])
    assert title.front and not (title.authors or title.body or title.references or title.graphics)
    assert c.for_fields(["references"]).references and not c.for_fields(["references"]).front and c.for_header().authors


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b."), (2, "c")], "doc_id BIGINT, text STRING")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.token_counts(streams.document_stream(spark, str(tmp_path / "in"), "doc_id BIGINT, text STRING"))
    streams.drain(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 3), (2, 1)]


def test_spans_of_whole_texts_are_those_of_their_tokens(spark):
    rules = [("<number>", r"^[0-9]+$"), ("<name>", r"^\p{Lu}"), ("<mark>", r"^[.,;:]$")]
    texts = ["Ab 12 , x\n\n  Éa  (y) z \n", "", "  \n \n", "12", "a\r\nB\tC d;\x1f.", "\n 😀 Ǆ ²", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    columns = ["doc_id", "span_no", "tag", "text", "n_tokens"]
    labelled = labels.with_rule_labels(layout.text_layout(docs), [(F.col("text").rlike(p), n) for n, p in rules])
    got = whole.spans(docs, [(p, n) for n, p in rules])
    assert sorted(got.select(columns).collect()) == sorted(labels.spans(labelled).select(columns).collect())
    assert not got._jdf.queryExecution().executedPlan().toString().count("Window")


TAGS = {
    "header": ["<title>", "<author>", "<affiliation>", "<address>", "<abstract>", "<note>", "O"], "name": ["<marker>", "<title>", "<forename>", "<middlename>", "<surname>", "<suffix>", "O"],
    "affiliation_address": ["<marker>", "<institution>", "<department>", "<postCode>", "<settlement>", "<country>", "O"],
    "fulltext": ["<paragraph>", "<section>", "<citation_marker>", "<figure_marker>", "<equation>", "<equation_label>", "<figure>", "<table>", "<item>", "O"],
    "figure": ["<label>", "<figDesc>", "<content>", "O"], "table": ["<label>", "<figDesc>", "O"], "reference_segmenter": ["<reference>", "<label>", "<reference>", "<reference>", "O"],
    "citation": ["<author>", "<title>", "<journal>", "<date>", "<pages>", "<pubnum>", "<web>", "<volume>", "<editor>", "<location>", "<note>", "O"],
}
SEGMENTS = ["<header>", "<body>", "<references>", "<acknowledgement>", "<annex>", "<references>", "<body>"]


def any_labels(df, model):
    """Labels by checksums of three lines of tokens' places and texts, so that all tags and their neighbours occur."""
    if model == "segmentation":
        number, tags = F.floor(F.col("line_no") / 5), SEGMENTS
    else:
        number, tags = F.crc32(F.concat(F.floor(F.col("token_no") / 2).cast("string"), F.lit(model), F.col("line_no").cast("string")).cast("binary")), TAGS[model]
    return labels.with_rule_labels(df, [(number % len(tags) == i, t) for i, t in enumerate(tags)])


def any_tags(found, model):
    from zlib import crc32

    if model == "segmentation":
        return [SEGMENTS[t.line // 5 % len(SEGMENTS)] for t in found]
    return [TAGS[model][crc32(f"{t.token // 2}{model}{t.line}".encode()) % len(TAGS[model])] for t in found]


def odd_texts(n, lines):
    import random

    r = random.Random(7)
    words = ["1", "12", "1999", "Ab", "CD", "é10.1234/ab", "10.12345/x", "x.", ",", "(", ")", "1.2", "2.", "-", "3-14", "123-30", "<a>", "&", '"', "Fig", "b", "Abstract", "ß", "PMC12", ";", "abstract:", "\u2028", "\x85", "\r", "\u00a0", "\U0001f600", "ǅ", "٣"]
    return ["\n".join(" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 9]))) for _ in range(lines)) for _ in range(n)] + ["", "\n \n", None, "One"]


@pytest.mark.parametrize("label, tag", [(document.rule_labeller, texts.rule_tags), (any_labels, any_tags)])
def test_whole_texts_become_the_documents_of_their_tokens(spark, label, tag):
    rows = list(enumerate(odd_texts(4, 80)))
    want = document.convert(layout.text_layout(spark.createDataFrame(rows, "doc_id LONG, text STRING"), colocate=True), label)
    made = {i: texts.converted_text(t, tag) for i, t in rows}
    assert {i: x for i, x in made.items() if x is not None} == dict(map(tuple, want.collect()))
    document.release(want)


@pytest.mark.parametrize("output", ["tei", "jats"])
def test_whole_texts_are_neither_shuffled_nor_kept(spark, output):
    rows = [(1, "A Title\nJane Doe 1\n1 Univ of X France\nAbstract text\nmore\n1 Head a b c\nand 12 more"), (2, " "), (3, None)]
    got = texts.convert(spark.createDataFrame(rows, "doc_id LONG, text STRING"), output)
    tei_ = texts.converted_text(rows[0][1])
    assert [tuple(r) for r in got.collect()] == [(1, tei_ if output == "tei" else jats.article(tei_))]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "hashpartitioning", "InMemory"))


def test_articles_are_written_as_by_the_library():
    for text in (*odd_texts(6, 80)[:6], "A\nB"):
        made = texts.converted_text(text.replace("\u2028", " "))
        built = jats._Article(ET.fromstring(made), jats.JatsOptions()).build()
        built.find("front").set("x", 'a"b<&>\n\t\r')
        assert jats.written(built) == ET.tostring(built, encoding="unicode")
    linked = jats._Article(ET.fromstring(TEI.replace("</figDesc>", '</figDesc><graphic url="a.png"/>')), jats.JatsOptions()).build()
    assert jats.written(linked) == ET.tostring(linked, encoding="unicode") and "xlink" in jats.written(linked)
