from pyspark.sql import functions as F

from quire.functions import text as T


def run(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, x STRING")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_tokens_and_spaces(spark):
    assert run(spark, T.tokens, ["token1. token2", " (a-b)\tc ", "", "x y†"]) == [["token1", ".", "token2"], ["(", "a", "-", "b", ")", "c"], [], ["x", "y", "†"]]
    parts = run(spark, T.tokenized, ["token1. token2"])[0]
    assert [(p.text, p.whitespace) for p in parts] == [("token1", ""), (".", " "), ("token2", "")]


def test_tokens_and_spaces_give_the_text_back(spark):
    texts = ["a  b.c", "x,\n y", "“q” – z"]
    for text, parts in zip(texts, run(spark, T.tokenized, texts)):
        assert "".join(p.text + p.whitespace for p in parts) == text


def test_normalized(spark):
    assert run(spark, T.normalized, ["ﬁve  –  “x”", "a \n b", "•∗`", "a  b"]) == ['five - "x"', "a\nb", "•*'", "a b"]
    assert run(spark, T.comma_separated, ["a, b ,c", "", " "]) == [["a", "b", "c"], [], []]


def test_word_shape(spark):
    cases = {"McDonalds": "XxXxxx", "a": "x", "ab": "xx", "abc": "xxx", "ABCDE": "XXXX", "1999": "dddd", "a-1": "x-d", "É9": "Xd"}
    assert run(spark, T.word_shape, list(cases)) == list(cases.values())


def test_status_features(spark):
    assert run(spark, T.digit_status, ["12", "a1", "a", "²"]) == ["ALLDIGIT", "CONTAINSDIGITS", "NODIGIT", "ALLDIGIT"]
    assert run(spark, T.caps_status, ["ABC", "Abc", "abc", "12", ".", ""]) == ["ALLCAP", "INITCAP", "NOCAPS", "NOCAPS", "ALLCAP", "NOCAPS"]
    assert run(spark, T.punctuation_type, ["(", "]", ".", ",", "-", "'", ":", ";?", "a"]) == ["OPENBRACKET", "ENDBRACKET", "DOT", "COMMA", "HYPHEN", "QUOTE", "PUNCT", "PUNCT", "NOPUNCT"]
    assert run(spark, T.punctuation_profile, ["a, b. (c)", "none"]) == [",.()", ""]
    assert run(spark, T.as_one_word, [" a b\tc "]) == ["a\u00a0b\u00a0c"]


def test_scaled(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (9, 10), (10, 10), (11, 10), (0, 0), (-1, 5)], "p INT, n INT")
    assert [r[0] for r in df.select(T.scaled(F.col("p"), F.col("n"), 10)).collect()] == [0, 5, 9, 10, 10, 10, 0]


def test_keys(spark):
    assert run(spark, T.key_text, ["Smith, 1999a"]) == ["smith1999a"]
    assert run(spark, T.prefix_key, ["Smith et al. 1999"]) == ["sea1999"]
    assert run(spark, lambda x: T.prefix_key(x, 3), ["Figure 1"]) == ["fig1"]
    assert run(spark, T.key_tokens, ["Smith, J."]) == [["smith", "", "j", ""]]


def test_parsers(spark):
    assert [tuple(r) for r in run(spark, T.page_range, ["1234-56", "12-15", "12", "1-2-3", "12 - 5"])] == [("1234", "1256"), ("12", "15"), (None, None), (None, None), ("12", "15")]
    cases = {"doi: 10.1234/test": ("DOI", "10.1234/test"), "PMC 1234567": ("PMCID", "PMC1234567"), "arXiv: 0706.0001": ("ARXIV", "0706.0001"), "arXiv:hep-th/9901001": ("ARXIV", "hep-th/9901001"),
             "PMID: 1234567": ("PMID", "1234567"), "see PMID: 1": (None, "seePMID:1"), "S01406736": (None, "S01406736"), "S0 14-067360567603701": ("PII", "S014-067360567603701")}
    assert [tuple(r) for r in run(spark, T.external_id, list(cases))] == list(cases.values())
    assert [tuple(r) for r in run(spark, T.web_link, ["http://doi.org/10.1000/x y", "http: //x"])] == [("DOI", "10.1000/xy"), ("URL", "http://x")]
    assert run(spark, T.year, ["(1999)", "in 20 01 x", "none"]) == [1999, 2001, None]
    assert [tuple(r) for r in run(spark, T.heading_parts, ["1 Intro", "2.1. Methods", "3Results", "Plain", "1.2"])] == [("1", "Intro"), ("2.1.", "Methods"), ("3", "Results"), (None, "Plain"), ("1", ".2")]
    assert run(spark, T.without_abstract_word, ["Abstract: We", "SUMMARY we", "a b s t r a c t x", "Résumé. Nous", "We"]) == ["We", "we", "x", "Nous", "We"]
    assert run(spark, T.title_case, ["o'conor-SMITH", "van der berg"]) == ["O'Conor-Smith", "Van Der Berg"]
    assert [[tuple(p) for p in r] for r in run(spark, T.marker_parts, ["1,12*"])] == [[("1", "marker"), (",", "marker_delimiter"), ("12", "marker"), ("*", "marker")]]
    assert [tuple(r) for r in run(spark, T.initials, ["JA", "Ja", "JAM"])] == [("J", "A"), ("Ja", None), ("JAM", None)]
    assert [tuple(r) for r in run(spark, T.date_parts, ["2001-02-03", "2001"])] == [("2001", "02", "03"), ("2001", None, None)]
    assert [tuple(r) for r in run(spark, T.tag_expression, ['note[@type="x"]', "p"])] == [("note", "type", "x"), ("p", None, None)]


def test_labels_and_xml(spark):
    assert run(spark, T.crf_label, ["O", "B-<a>", "I-<a>", "x"]) == ["<other>", "I-<a>", "<a>", "x"]
    assert [tuple(r) for r in run(spark, T.split_label, ["B-<a-b>", "O"])] == [("B", "<a-b>"), ("", "O")]
    assert run(spark, T.without_prefix, ["B-<a>", "O"]) == ["<a>", "O"] and run(spark, T.note_type, ["<a>"]) == ["a"]
    assert run(spark, T.escaped_attribute, ['a<"&>']) == ["a&lt;&quot;&amp;&gt;"]
    assert run(spark, T.xml_text, ["<a>x<b>y</b>z</a>"]) == ["xyz"]
    assert run(spark, lambda x: T.changed_extension(x, ".docx", ".pdf"), ["a/b.docx.gz", "c.docx"]) == ["a/b.pdf", "c.pdf"]


def test_identifiers_after_letters_of_other_scripts(spark):
    """A word boundary is between ASCII word characters and others, as in the SQL."""
    ids = run(spark, T.external_id, ["é10.1234/ab", "x10.1234/ab", "中S0140673605676037", "é,4111111111111111", "a,4111111111111111"])
    assert [tuple(r) for r in ids] == [("DOI", "10.1234/ab"), (None, "x10.1234/ab"), ("PII", "S0140673605676037"), (None, "é,4111111111111111"), ("PII", ",4111111111111111")]
    assert [tuple(r) for r in run(spark, T.web_link, ["ß10.1234/ab", "_10.1234/ab"])] == [("DOI", "10.1234/ab"), ("URL", "_10.1234/ab")]
