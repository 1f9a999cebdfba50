from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import markdown as M
from corpuslens.operators import markdown as MD

DOC = """# Title **bold** `c*d*`

para | x
--- | ---:
a `b` | c \\| d
only
one | two | three

```bash
# not heading
- no
``

```

~~~
```
inner
~~~
## Sub ##
- one
- two
  cont
  - nested a
    1. deep
    5. deep2
  - nested b

- three
* other
7. x
9. y
   ```py
     code
   ```
10. z

***
| h |
|:-:|
| 1 |
text after `unclosed
```
tail"""


@pytest.fixture(scope="module")
def doc(spark):
    return spark.createDataFrame([(1, DOC)], "id int, text string").cache()


def test_lines_cover_the_document_once(doc):
    rows = MD.md_lines(doc).orderBy("line_no").collect()
    assert [r["text"] for r in rows] == DOC.split("\n")
    assert [r["line_no"] for r in rows] == list(range(1, len(rows) + 1))
    fenced = {r["fence_no"]: r["lang"] for r in rows if r["in_fence"]}
    assert fenced == {1: "bash", 2: "", 3: "py", 4: ""}
    assert [r["line_no"] for r in rows if r["fence_no"] == 2] == [16, 17, 18, 19]


def test_headings_outside_fences(doc):
    rows = MD.md_headings(doc).orderBy("line_no").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, 1, "Title bold `c*d*`"), (20, 2, "Sub")]


def test_code_blocks(doc):
    rows = MD.md_code_blocks(doc).orderBy("block_no").collect()
    assert [tuple(r)[1:] for r in rows] == [
        (1, "bash", "# not heading\n- no\n``\n"),
        (2, "", "```\ninner"),
        (3, "py", "  code"),
        (4, "", "tail"),
    ]


def test_tables(doc):
    rows = MD.md_tables(doc).orderBy("table_no").collect()
    first, second = rows
    assert first["headers"] == ["para", "x"] and first["aligns"] == ["left", "right"]
    assert first["rows"] == [["a b", "c | d"], ["only", ""], ["one", "two"]]
    assert (second["line_no"], second["aligns"]) == (39, ["center"])
    capped = MD.md_tables(doc, max_rows=2).orderBy("table_no").collect()[0]
    assert len(capped["rows"]) == 2 and capped["more_rows"] == 1


def test_lists(doc):
    rows = MD.md_lists(doc).orderBy("line_no").collect()
    assert [r["rendered"] for r in rows] == [
        "• one",
        "• two cont",
        "  • nested a",
        "    1. deep",
        "    2. deep2",
        "  • nested b",
        "• three",
        "• other",
        "7. x",
        "8. y",
        "10. z",
    ]
    assert [r["list_no"] for r in rows] == [1] * 7 + [2, 3, 3, 4]


def test_blank_and_mismatched_blocks_are_dropped(spark):
    text = "```\n \n```\n\n| a | b |\n|---|\n| 1 |\n"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert MD.md_code_blocks(df).count() == 0
    assert MD.md_tables(df).count() == 0


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("**a** and *b* and ***c***", "a and b and c"),
        ("`**x**` **y `z*` w** ~~s~~", "`**x**` y `z*` w s"),
        ('[link *t*](http://x "t") end', "link t end"),
        ("![](a.png) ![alt](a.png)", "[image: image] [image: alt]"),
        ('![alt](a.png "ti") ![](x "only")', "[image: ti alt] [image: only]"),
        ("[![badge](b.svg)](u) <https://a.b>", "[image: badge] https://a.b"),
        ("snake_case_name _em_ __st__", "snake_case_name em st"),
        (r"\*no\* a*b*c 2 * 3 * 4", "*no* abc 2 * 3 * 4"),
        ("a `![x](y)` b", "a `![x](y)` b"),
        ("plain, text.", "plain, text."),
        ("", ""),
    ],
)
def test_inline(apply, source, want):
    assert apply(M.inline_text, source) == [want]


def test_inline_without_ticks(apply):
    assert apply(lambda c: M.inline_text(c, False), "a `b*` ``c`d``") == ["a b* c`d"]


def test_pad_cells(spark):
    df = spark.createDataFrame([(["a"],), (["a", None, "c", "d"],), ([],)], "c array<string>")
    got = [r[0] for r in df.select(M.pad_cells(F.col("c"), 3)).collect()]
    assert got == [["a", "", ""], ["a", "", "c"], ["", "", ""]]


def test_fences_like_a_scan(spark):
    """In/out of fence on random documents against a line scanner."""
    rng = random.Random(5)
    pool = ["```", "````", "~~~", "~~~~ x", "```sql", "   ```", "text", "", "- a", "| a |", "|---|", "# h", "``` `"]
    docs = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(300)]

    def model(text: str) -> list[bool]:
        flags, opened = [], None
        for line in text.split("\n"):
            bare = line.lstrip(" ")
            mark = bare[: len(bare) - len(bare.lstrip(bare[:1]))] if bare[:1] in ("`", "~") and bare else ""
            rest = bare[len(mark):]
            if opened is None:
                if len(mark) >= 3 and not (mark[0] == "`" and "`" in rest):
                    opened = mark
                    flags.append(True)
                else:
                    flags.append(False)
            else:
                flags.append(True)
                if mark[:1] == opened[0] and len(mark) >= len(opened) and not rest.strip():
                    opened = None
        return flags

    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    got: dict[int, list[tuple]] = {}
    for r in MD.md_lines(df).collect():
        got.setdefault(r["id"], []).append((r["line_no"], r["in_fence"]))
    for i, text in enumerate(docs):
        assert [f for _, f in sorted(got[i])] == model(text), text


def test_long_documents(spark):
    """Blocks of many lines, and many blocks: patterns must not recurse."""
    n = 40_000
    text = "```\n" + "x\n" * n + "```\n" + "- i\n" * 2000 + "\n| a |\n|---|\n" + "| b |\n" * n + "\n" + "p\n" * n
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert MD.md_lines(df).filter("in_fence").count() == n + 2
    assert MD.md_tables(df).collect()[0]["more_rows"] == n - 1000
    assert MD.md_lists(df).count() == 2000


def test_markdown_needs_no_shuffle(doc):
    for op in (MD.md_lines, MD.md_headings, MD.md_code_blocks, MD.md_tables, MD.md_lists):
        assert "Exchange" not in op(doc)._jdf.queryExecution().toString()


def test_underlined_quoted_and_indented(spark):
    text = (
        "Two\nlines *here*\n  ====\n\nNot one\n\n---\n> # In *quote*\n> text\n> ---\n>\n> > ### Deep\n> >\n> > ```\n> > # no\n"
        "> > ```\npara\n    still para\n\n    code 1\n\n\tcode 2\n      code 3\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n"
        "last\n| c | d |\n|---|---|\nplain\n---\n- item\n-----\n"
    )
    df = spark.createDataFrame([(1, text)], "id int, text string")
    heads = [tuple(r)[1:] for r in MD.md_headings(df).orderBy("line_no").collect()]
    assert heads == [(1, 1, "Two lines here"), (8, 1, "In quote"), (9, 2, "text"), (12, 3, "Deep")]
    code = [tuple(r)[1:] for r in MD.md_code_blocks(df).orderBy("block_no").collect()]
    assert code == [(1, "", "# no"), (2, "", "code 1\n\ncode 2\n  code 3")]
    tables = [(r["line_no"], r["headers"], r["rows"]) for r in MD.md_tables(df).orderBy("table_no").collect()]
    assert tables[0] == (25, ["a", "b"], [["1", "2"]]) and tables[1][:2] == (30, ["c", "d"])
    lines = MD.md_lines(df).filter("line_no in (8, 12)").orderBy("line_no").collect()
    assert [r["text"] for r in lines] == ["> # In *quote*", "> > ### Deep"]


def test_long_paragraphs_and_quotes_take_linear_time(spark):
    text = "word word\n" * 60_000 + "====\n\n" + "> quoted\n" * 60_000 + "\n" + "    code\n" * 60_000
    df = spark.createDataFrame([(1, text)], "id int, text string")
    heads = MD.md_headings(df).collect()
    assert [(h["line_no"], h["level"], len(h["text"])) for h in heads] == [(1, 1, 600_000 - 1)]
    assert len(MD.md_code_blocks(df).collect()[0]["code"]) == 5 * 60_000 - 1


def test_references(spark):
    text = (
        "# [Two][a  B] and ![x][t] [t][] [T] [none][no] \\[t] `[t]` [t](u) [**b**][t]\n\n"
        "| [h][t] |\n|---|\n| ![][t] |\n\n> - [t]\n\n[A b]: <u> 'ti'\n[t]: u \"Title\"\n[t]: v \"later\"\n"
        "```\n[no]: x\n```\n"
    )
    df = spark.createDataFrame([(1, text), (2, "# [t] [a][b]\n")], "id int, text string")
    heads = {r["id"]: r["text"] for r in MD.md_headings(df).collect()}
    assert heads[1] == "Two and [image: Title x] t T [none][no] [t] `[t]` t b"
    assert heads[2] == "[t] [a][b]"
    table = MD.md_tables(df).collect()[0]
    assert (table["headers"], table["rows"]) == (["h"], [["[image: Title]"]])
    assert [r["text"] for r in MD.md_lists(df).collect()] == ["t"]


def test_many_references_to_many_definitions(spark):
    links = "".join(f"- [a{i}][n {i % 400}] ![p][N  {i % 400}]\n" for i in range(4_000))
    text = links + "\n" + "".join(f"[n {i}]: u 't{i}'\n" for i in range(400))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    begun = time.monotonic()
    rows = [r["text"] for r in MD.md_lists(df).collect()]
    assert rows == [f"a{i} [image: t{i % 400} p]" for i in range(4_000)]
    assert time.monotonic() - begun < 8
