"""Formulas cut into lexemes, and moved to another cell, as Spark columns.

The lexer is a fold over the characters of a formula by one transition table. It tells apart what only looks alike: A1 in
a quoted text, in a sheet's name, in a table's brackets, in the name of a function, and as a reference. `moved` needs no
more than that: it shifts the references among the words and leaves all other lexemes as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.text import letters_sql, sql_text

ROWS, COLUMNS = 1_048_576, 16_384
OUTSIDE = "#REF!"

#: Classes of characters: the special ones by their place in this text, then words; 0 is any other.
SPECIAL = "\"'[]!#/?"
WORDS = r"[\p{L}\p{N}_.$:\\@]"
CLASSES = len(SPECIAL) + 2
#: States. TEXT, NAME and BRACKET end with DONE, which ends the lexeme, too.
OPERATOR, WORD, TEXT, NAME, BRACKET, ESCAPE, ERROR, ERROR_REST, DONE = range(9)
#: The next state by state (rows) and class (columns: other " ' [ ] ! # / ? word).
TRANSITIONS = (
    (OPERATOR, TEXT, NAME, BRACKET, OPERATOR, OPERATOR, ERROR, OPERATOR, WORD, WORD),  # OPERATOR
    (OPERATOR, TEXT, NAME, BRACKET, OPERATOR, OPERATOR, OPERATOR, OPERATOR, WORD, WORD),  # WORD
    (TEXT, DONE, TEXT, TEXT, TEXT, TEXT, TEXT, TEXT, TEXT, TEXT),  # TEXT
    (NAME, NAME, DONE, NAME, NAME, NAME, NAME, NAME, NAME, NAME),  # NAME
    (BRACKET, BRACKET, ESCAPE, BRACKET, DONE, BRACKET, BRACKET, BRACKET, BRACKET, BRACKET),  # BRACKET: DONE only at the outermost ]
    (BRACKET,) * 10,  # ESCAPE
    (OPERATOR, TEXT, NAME, BRACKET, OPERATOR, DONE, ERROR, ERROR_REST, DONE, ERROR),  # ERROR: #REF! #NAME?
    (OPERATOR, TEXT, NAME, BRACKET, OPERATOR, DONE, OPERATOR, OPERATOR, DONE, ERROR_REST),  # ERROR_REST: #N/A #DIV/0!
    (OPERATOR, TEXT, NAME, BRACKET, OPERATOR, OPERATOR, ERROR, OPERATOR, WORD, WORD),  # DONE
)
#: The states that go on with a lexeme in the state before; any other begins a new one.
CONTINUES = ((OPERATOR,), (WORD,), (TEXT, DONE), (NAME, DONE), (BRACKET, ESCAPE, DONE), (BRACKET,), (ERROR, ERROR_REST, DONE), (ERROR_REST, DONE), ())
BEGINS = 16
#: The table as it is looked up: the next state, and BEGINS more where it begins a lexeme.
FLAT = [to + BEGINS * (to not in CONTINUES[state]) for state, row in enumerate(TRANSITIONS) for to in row]
LEXEMES = "array<struct<kind:int,text:string>>"
PIECE = "struct<text:string,letters:string,column:bigint,row_sign:string,row:bigint,column_held:boolean,row_held:boolean>"

# What follows is SQL text in the place of Column calls: a fold of this size is built, sent and analysed many times faster.


def bound(value: str, name: str, body: str) -> str:
    """body with `name` standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def lexemes_sql(formula: str) -> str:
    kind = f"case when instr({sql_text(SPECIAL)}, ch) > 0 then instr({sql_text(SPECIAL)}, ch) when ch rlike {sql_text(WORDS)} then {CLASSES - 1} else 0 end"
    code = f"array({', '.join(map(str, FLAT))})[a.state * {CLASSES} + c]"
    opens = f"a.state in ({OPERATOR}, {WORD}, {BRACKET}, {ERROR}, {ERROR_REST}, {DONE})"
    depth = f"a.depth + case when c = 3 and {opens} then 1 when c = 4 and a.state = {BRACKET} then -1 else 0 end"
    ended = "case when a.text = '' then a.out else concat(a.out, array(named_struct('kind', a.kind, 'text', a.text))) end"
    new = f"m.code >= {BEGINS}"
    after = (
        f"named_struct('state', case when m.code % {BEGINS} = {DONE} and a.state = {BRACKET} and m.depth > 0 then {BRACKET} else m.code % {BEGINS} end, 'depth', m.depth, "
        f"'kind', case when {new} then m.code % {BEGINS} else a.kind end, 'text', case when {new} then ch else concat(a.text, ch) end, 'out', case when {new} then {ended} else a.out end)"
    )
    step = bound(kind, "c", bound(f"named_struct('code', {code}, 'depth', {depth})", "m", after))
    start = f"named_struct('state', {OPERATOR}, 'depth', 0, 'kind', {OPERATOR}, 'text', '', 'out', cast(array() as {LEXEMES}))"
    return f"aggregate(regexp_extract_all({formula}, '(?s).', 0), {start}, (a, ch) -> {step}, a -> {ended})"


def column_sql(letters: str) -> str:
    """A to 1, XFD to 16384."""
    return f"aggregate(split(upper({letters}), ''), 0L, (n, l) -> n * 26 + ascii(l) - 64)"


def column_of(letters: Column) -> Column:
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"), lambda n, ch: n * 26 + F.ascii(ch) - 64)


CELL, WHOLE_COLUMN, WHOLE_ROW = r"^(\$?)([A-Za-z]{1,3})(\$?)([1-9][0-9]{0,6})$", r"^(\$?)([A-Za-z]{1,3})$", r"^(\$?)([1-9][0-9]{0,6})$"


def _piece(letters: str = "null", row_sign: str = "null", row: str = "null") -> str:
    """A piece p of a word: a name (text only), or what it refers to. letters and row_sign have their dollar sign."""
    column = "null" if letters == "null" else column_sql(f"ltrim('$', {letters})")
    held = lambda c: "null" if c == "null" else f"startswith({c}, '$')"
    return f"cast(named_struct('text', p, 'letters', {letters}, 'column', {column}, 'row_sign', {row_sign}, 'row', {row}, 'column_held', {held(letters)}, 'row_held', {held(row_sign)}) as {PIECE})"


def _pieces(words: str) -> str:
    """The pieces of a word between its colons: cells, two whole columns, two whole rows, or names."""
    part = lambda pattern, group: f"regexp_extract(p, {sql_text(pattern)}, {group})"
    fits = lambda pattern: f"p rlike {sql_text(pattern)}"
    number = lambda pattern, group: f"try_cast({part(pattern, group)} as bigint)"
    columns = f"{fits(WHOLE_COLUMN)} and {column_sql(part(WHOLE_COLUMN, 2))} <= {COLUMNS}"
    rows = f"{fits(WHOLE_ROW)} and {number(WHOLE_ROW, 2)} <= {ROWS}"
    cell = f"{fits(CELL)} and {column_sql(part(CELL, 2))} <= {COLUMNS} and {number(CELL, 4)} <= {ROWS}"
    as_cell = _piece(f"concat({part(CELL, 1)}, {part(CELL, 2)})", part(CELL, 3), number(CELL, 4))
    return (
        f"case when size({words}) = 2 and forall({words}, p -> {columns}) then transform({words}, p -> {_piece(f'concat({part(WHOLE_COLUMN, 1)}, {part(WHOLE_COLUMN, 2)})')}) "
        f"when size({words}) = 2 and forall({words}, p -> {rows}) then transform({words}, p -> {_piece(row_sign=part(WHOLE_ROW, 1), row=number(WHOLE_ROW, 2))}) "
        f"else transform({words}, p -> case when {cell} then {as_cell} else {_piece()} end) end"
    )


def compiled_sql(formula: str) -> str:
    following = "substring(coalesce(try_element_at(tokens, i + 2).text, ''), 1, 1)"
    qualified = "(i > 0 and endswith(coalesce(try_element_at(tokens, greatest(i, 1)).text, ''), '!'))"
    whole = f"not {following} in ('!', '(', '[')"
    # a function, a table, a sheet's name, or two that sheets lie between, stays
    stays = f"not ({whole}) and (size(w) = 1 or {following} = '!' and not {qualified})"
    head = f"case when {whole} then w else slice(w, 1, size(w) - 1) end"
    word = bound(
        "split(t.text, ':')", "w",
        f"named_struct('text', case when {stays} then t.text end, 'pieces', case when not ({stays}) then {bound(head, 'refers', _pieces('refers'))} end, "
        f"'tail', case when not ({stays}) and not ({whole}) then concat(':', element_at(w, -1)) else '' end)",
    )
    fixed = f"named_struct('text', t.text, 'pieces', cast(null as array<{PIECE}>), 'tail', '')"
    return bound(lexemes_sql(formula), "tokens", f"transform(tokens, (t, i) -> case when t.kind = {WORD} then {word} else {fixed} end)")


def placed_sql(template: str, right: str, down: str) -> str:
    column, row = f"(p.column + {right})", f"(p.row + {down})"
    letters = f"case when p.column is null then '' when p.column_held then p.letters when {column} between 1 and {COLUMNS} then {letters_sql(column)} end"
    digits = f"case when p.row is null then '' when p.row_held then concat(p.row_sign, cast(p.row as string)) when {row} between 1 and {ROWS} then cast({row} as string) end"
    piece = f"case when p.column is null and p.row is null then p.text else concat({letters}, {digits}) end"
    shifted = bound(f"transform(t.pieces, p -> {piece})", "s", f"case when exists(s, x -> x is null) then {sql_text(OUTSIDE)} else array_join(s, ':') end")
    return f"array_join(transform({template}, t -> case when t.pieces is null then t.text else concat({shifted}, t.tail) end), '')"


def lexemes(formula: str) -> Column:
    """array<struct<kind, text>>: the formula (a column, as SQL text) in pieces, kind being the state a piece began in."""
    return F.expr(lexemes_sql(formula))


def compiled(formula: str) -> Column:
    """array<struct<text, pieces, tail>>: a formula ready to be placed. A lexeme that stays has its text; a word that refers
    has pieces, and a tail where something follows its last colon that doesn't refer (the INDEX of A1:INDEX())."""
    return F.expr(compiled_sql(formula))


def placed(template: str, right: str, down: str) -> Column:
    """The text of a compiled formula `right` columns and `down` rows away from where it stood. That is arithmetic only."""
    return F.expr(placed_sql(template, right, down))


def moved(formula: str, right: str, down: str) -> Column:
    """The formula as it reads `right` columns and `down` rows away: cells, ranges, whole columns and whole rows move
    along unless a dollar sign holds them, and become #REF! where they leave the sheet. Texts, sheet names, brackets,
    function names, error values and other names stay."""
    return F.expr(bound(compiled_sql(formula), "template", placed_sql("template", right, down)))
