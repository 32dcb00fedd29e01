import pytest
from conftest import DATA

from flowloom.llm.lexicon import SPACE, Lexicon, vocabulary_words
from flowloom.llm.sentences import document_sentences, sentence_spans


def split(cell, names=()):
    return [cell[a:b] for a, b in sentence_spans(cell, lambda: frozenset(names))]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Diki measured 47.08 mg/L at site No. 16, cf. Fig. 952 and Tab. 621.", "No.", "The run stopped at 8:30 a.m. because it was empty."],
        ["The nightly job starts at 9 p.m.", "J. R. Gayarost et al. describe it.", "We plot means, etc. in full."],
        ["Anything above 9. is clipped to 9. by the split.", "Accuracy fell by .6 points."],
        ["“Is it flat? Not yet!” wrote Komo in the log.", "'It works!' claimed Tumi.", "Pell said \"stop.\" and went home.", 'Vozo asked: "Why?"', "Then it ended."],
        ["(See Sect. 9.9 for it.)", "Use v8.1.4, e.g. from docs.example.org/v9/index.html, and rerun."],
        ["It grew… and so did we.", "Wait... does it?", "What if it hides everything?!"],
        ["framely.fit() returns a frame.", "plotta feeds it."],
        ["One thing; another thing.", "**Bold words** start here.", "**All bold.**", "Next."],
        ["Im 2. Lauf bremst das Modell u. a. wegen der Uhrzeit.", "Am 5. März lag er bei 8,8 (vgl. Abb. 9).", "Dr. Tefa fragt: „Warum?“", "Das sind 3.550 Zeilen bzw. Nr. 599 usw.", "„Fertig!“, rief Lomapa."],
        ["On garde env. 9 points, p. ex. ceux de la fig. 9.", "« Est-ce fini ? » demande M. Tumi.", "Attention !", "Mme Pazo répond : « Oui. »"],
        ["Son 7.690 filas, p. ej. las del núm. 965.", "«¿Listo?», preguntó la Dra. Vozo.", "¡Cuidado!", "Hoy sube... y mañana también."],
        ["Мы взяли ок. 101 строк, т. е. 770 на группу.", "А. В. Тодеса пишет, что это имя, дата и т. д.", "«Готово!» — сказал д-р Ломига."],
        ["هنا المنحنى.", "«هل انتهى؟» سأل Norve ثم حفظ.", "قاس د. Kelcrim القيمة 38.97.", "توقف!"],
        ["डॉ. Mokoke ने 9.9 मिमी मापा।", "“ठीक है।” कहकर वह गया।", "क्या यह सही है?"],
        ["ชุดฝึกขึ้นกับตารางข้อมูล", "ค่าเฉลี่ยมี 554 แถว", "เปิดไฟล์ raw.v1.csv ก่อนวาดกราฟ"],
    ],
)
def test_spaced_and_thai(parts):
    assert split(" ".join(parts)) == parts
    assert split("\n".join(parts)) == parts
    assert split("  ".join(parts)) == parts


@pytest.mark.parametrize("parts", [["她说：“特征矩阵覆盖了训练集。”", "“稳定吗？”他写道，然后继续。", "也许……还要再试一次。", "（参见第3.9节。）", "使用 v9.9 版本！"], ["「本当ですか。」と彼が書きました。", "図4．8を見てください。", "なぜですか？"]])
def test_without_spaces(parts):
    assert split("".join(parts)) == parts


def test_missing_and_double_spaces():
    assert split("It stays flat.Is it?  Yes.Dr. Who left.") == ["It stays flat.", "Is it?", "Yes.", "Dr. Who left."]
    assert split("data/raw.V9.csv holds np.Array values.") == ["data/raw.V9.csv holds np.Array values."]


def test_blocks():
    cell = "# Title v6.8 #\n\nFirst line\r\nwraps on. Second\n\n- item one\n- item two. More\n  of it\n1. a\n2. b\n\n> quoted text\n> goes on.\n\n```python\nx = 1. y\n```\n\n$$\nL = 2.\n$$\n\n| a | b |\n|---|---|\n| 1. | 2 |\n\n![alt. text](data:image/png;base64,AAA.BBB)\n\nUnderlined\n====\n\nEnd `a. B` here. Last"
    assert [s.replace("\r", "").replace("\n", " ") for s in split(cell)] == ["Title v6.8", "First line wraps on.", "Second", "item one", "item two.", "More   of it", "a", "b", "quoted text > goes on.", "Underlined", "End `a. B` here.", "Last"]


def test_wrapped_number_is_no_list_item():
    assert split("Values are clipped to\n9. by the split.") == ["Values are clipped to\n9. by the split."]


def test_edges():
    assert split("") == [] and sentence_spans(None) == [] and split("...") == [] and split("\n\n---\n\n***") == []
    assert split("a") == ["a"] and split("(unclosed text. Next one.") == ["(unclosed text.", "Next one."]
    assert len(split("Word word. " * 20_000)) == 20_000
    assert "".join(Lexicon().read("ค่าเฉลี่ยxมี")[0]) == "ค่าเฉลี่ยxมี" and Lexicon().read("") == ([], 0.0)


def test_lattice_of_words():
    own = ["ตาราง", "ข้อมูล", "ช้า", "กว่า", "กราฟ"]
    assert Lexicon(own).read("ตารางข้อมูลช้ากว่ากราฟ")[0] == own
    assert Lexicon().read("ありがとうございますしかし")[0][-1] == "しかし"
    assert Lexicon(path="/nowhere").cost and len(vocabulary_words("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")) > 500


def test_dictionary_decides():
    """Words make gaps ends or not: a word that a line break cuts, an ellipsis between a closing and an opening word."""
    broken = "กราฟเส้นแสดงข้อ\nมูลทั้งหมด"
    spans = lambda cell, *own: [cell[a:b] for a, b in sentence_spans(cell, frozenset, lambda: Lexicon(own))]
    assert spans(broken, "ข้อมูล", "ทั้งหมด", "กราฟ", "เส้น", "แสดง") == [broken]
    assert len(spans(broken)) == 2
    assert len(spans("กราฟเส้นแสดงข้อมูล\nทั้งหมดนี้", "ข้อมูล", "ทั้งหมด", "กราฟ", "เส้น", "แสดง")) == 2
    assert split("足りませんね…しかし表は残ります。") == ["足りませんね…", "しかし表は残ります。"]
    assert split("もしかすると…表は残ります。") == ["もしかすると…表は残ります。"]
    assert split("「本当ですか。」しかし表は残ります。") == ["「本当ですか。」", "しかし表は残ります。"]
    assert Lexicon().gap_score("ช้ามาก", "ๆ", SPACE) < 0 < Lexicon().gap_score("ช้าครับ", "แต่ดี", SPACE)


def test_path_decides():
    """The same unclear mark is an end or not by the sentences that it would cut out."""
    assert split("Use trees, nets, etc. Boosting too in all runs. Next.") == ["Use trees, nets, etc.", "Boosting too in all runs.", "Next."]
    assert split("**Use trees, nets, etc. Boosting too** in all runs. Next.") == ["**Use trees, nets, etc. Boosting too** in all runs.", "Next."]


def test_tables(spark):
    cell = "kind string, execution_count int, mime string, start_char int, end_char int"
    rows = [
        (1, "A. code\n\nOne 😀. Two.", [("code", 1, None, 0, 7), ("markdown", None, None, 9, 20)]), (2, None, [("markdown", None, None, 0, 3)]), (3, "", []), (4, "text", None), (5, "Hi.", [("markdown", None, None, -2, 99), ("markdown", None, None, None, 2), None]), (1, "X.", [("markdown", None, None, 0, 2)]),
    ]
    df = spark.createDataFrame(rows, f"doc_id long, text string, cells array<struct<{cell.replace(' ', ':').replace(',:', ',')}>>")
    got = sorted(map(tuple, document_sentences(df).collect()))
    assert got == [(1, 0, 2), (1, 9, 15), (1, 16, 20), (5, 0, 3)]
    assert document_sentences(df.limit(0)).count() == 0
    assert sorted(map(tuple, document_sentences(df, vocabulary="/nowhere").collect())) == got


def test_thai_dictionary_of_a_document(spark):
    """A word known from elsewhere in the document isn't cut by a line break."""
    text = "กราฟเส้นแสดงข้อ\nมูลทั้งหมด\n\nข้อมูลแถวแรก"
    cell = "array<struct<kind:string,execution_count:int,mime:string,start_char:int,end_char:int>>"
    df = spark.createDataFrame([(1, text, [("markdown", None, None, 0, len(text))])], f"doc_id long, text string, cells {cell}")
    assert [text[r.start_char : r.end_char] for r in document_sentences(df).orderBy("start_char").collect()] == text.split("\n\n")


def test_registered(spark):
    from flowloom.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = [tuple(r) for r in QUERIES["p8_found"](spark, DATA).collect()]
    assert rows and len(rows) == len(set(rows))
    assert all(docs[d][a:b] == docs[d][a:b].strip() and a < b for d, a, b in rows)
