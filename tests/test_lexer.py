"""The formula lexer against formulas that a grammar of their own puts together."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.functions import lexer

SHEETS = ["", "", "", "Q1!", "FY24!", "Data!", "'My Q1'!", "'O''x A1'!", "[1]Q1!", "'[b.xlsx]A1'!", "Jan:Dec!", "Q1:Q4!", "Größe1!"]


def letters(n):
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


class Grammar:
    """Each part gives its text at the origin and at the target; it knows what it wrote, so it reads nothing."""

    def __init__(self, rng, right, down):
        self.rng, self.right, self.down = rng, right, down

    def column(self, near=False):
        n, held = self.rng.choice([1, 2, 5, 26, 27, 703, 16384]) if not near else self.rng.randint(1, 40), self.rng.random() < 0.3
        to = n if held else n + self.right
        return "$" * held + letters(n), "$" * held + letters(to) if 1 <= to <= 16384 else None

    def row(self):
        n, held = self.rng.choice([1, 2, 9, 10, 1048576, self.rng.randint(1, 5000)]), self.rng.random() < 0.3
        to = n if held else n + self.down
        return "$" * held + str(n), "$" * held + str(to) if 1 <= to <= 1048576 else None

    def cell(self):
        (c, d), (r, s) = self.column(), self.row()
        return c + r, None if d is None or s is None else d + s

    def reference(self):
        kind, sheet = self.rng.randrange(4), self.rng.choice(SHEETS)
        parts = [self.cell()] if kind == 0 else [self.cell(), self.cell()] if kind == 1 else [self.column(), self.column()] if kind == 2 else [self.row(), self.row()]
        if kind == 2 and sheet == "Jan:Dec!":
            sheet = ""
        here, there = ":".join(a for a, _ in parts), None if any(b is None for _, b in parts) else ":".join(b for _, b in parts)
        return sheet + here, sheet + (there or "#REF!")

    def fixed(self):
        t = self.rng.choice(['"A1 and ""B2"" [C3"', "1.5E3", "42", "Rate", "TAX_A1", "_A1", "A1_", "Table1[Q1]", "Table1[[#This Row],[A1]:[B2]]", "T['[A1]", "#REF!", "#N/A", "#DIV/0!", "#NAME?", "TRUE", "XFE1", "A1048577", "ABCD1", "[2]!Name", "{1,2;3,4}", "\"😀B2\"", "a.b1", "R_1.A2"])
        return t, t

    def call(self, depth):
        name = self.rng.choice(["SUM", "LOG10", "ATAN2", "_xlfn.XLOOKUP", "DAYS360", ""])
        args = [self.expression(depth - 1) for _ in range(self.rng.randint(0 if name else 1, 3))]
        sep = self.rng.choice([",", ", "])
        return tuple(f"{name}({sep.join(a[k] for a in args)})" for k in (0, 1))

    def expression(self, depth):
        out = ["", ""]
        for i in range(self.rng.randint(1, 3)):
            part = self.call(depth) if depth and self.rng.random() < 0.3 else self.reference() if self.rng.random() < 0.6 else self.fixed()
            op = self.rng.choice(["+", "-", "*", "/", "&", "<>", ">=", " & ", "^"]) if i else self.rng.choice(["", "", "-"])
            out = [o + op + p for o, p in zip(out, part)]
        return tuple(out)


@pytest.mark.parametrize("seed", range(3))
def test_grammar(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        right, down = rng.choice([(0, 1), (1, 0), (1, 1), (-1, -1), (-3, 2), (700, 3000), (0, 0)])
        rows.append((*Grammar(rng, right, down).expression(2), right, down))
    table = spark.createDataFrame(rows, "f string, want string, right int, down int")
    got = table.select("f", "want", "right", "down", lexer.moved("f", "right", "down").alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []
    pieces = table.select("f", F.array_join(F.transform(lexer.lexemes("f"), lambda t: t["text"]), "").alias("back")).collect()
    assert all(r.f == r.back for r in pieces)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Q1!A1+1", "Q1!B2+1"), ("FY24!B2", "FY24!C3"), ("Table1[Q1]+A1", "Table1[Q1]+B2"), ("SUM(A:A)", "SUM(B:B)"), ("SUM(1:1)", "SUM(2:2)"), ("A1+$A$1&A$1&$A1", "B2+$A$1&B$1&$A2"),
        ("XFD1", "#REF!"), ("A1048576:B2", "#REF!"), ("A1:INDEX(B:B,2)", "B2:INDEX(C:C,2)"), ("Q1!A1:Q1!B2", "Q1!B2:Q1!C3"), ("OFFSET(A1,1,1):B2", "OFFSET(B2,1,1):C3"), ("A1#", "B2#"), ("a1", "B2"),
        ("", ""), ("=", "="), ("\"open A1", "\"open A1"), ("'open A1", "'open A1"), ("T[open A1", "T[open A1"), ("#N/A+A1/B1", "#N/A+B2/C2"), ("Σ1+A1\nA1", "Σ1+B2\nB2"), (None, None),
    ],
)
def test_known_formulas(spark, text, want):
    table = spark.createDataFrame([(text,)], "f string")
    assert table.select(lexer.moved("f", "1", "1")).collect()[0][0] == want


def test_kinds(spark):
    table = spark.createDataFrame([("'a'!B1+\"x\"&T[[c]]+#N/A",)], "f string")
    got = [(r.kind, r.text) for r in table.select(lexer.lexemes("f").alias("t")).collect()[0].t]
    assert got == [(lexer.NAME, "'a'"), (lexer.OPERATOR, "!"), (lexer.WORD, "B1"), (lexer.OPERATOR, "+"), (lexer.TEXT, '"x"'), (lexer.OPERATOR, "&"), (lexer.WORD, "T"), (lexer.BRACKET, "[[c]]"), (lexer.OPERATOR, "+"), (lexer.ERROR, "#N/A")]
