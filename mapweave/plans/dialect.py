"""A small SELECT dialect with two-valued logic and strict types, turned into DataFrame calls.

``run(sql, tables)`` parses the text and builds the plan; types are known from the tables' schemas when the plan is
built, so every rule of typing is settled there and what runs are plain column expressions. The dialect's own rules:

* A predicate is true or false, never unknown: an atom over a null is false, so ``not (a = 1)`` is true for a null a.
* Values of different types never compare, not even integer with float, not even for ``<>``.
* ``in`` works on strings and floats; on integers it is always false.
* ``like`` knows one pattern, a prefix followed by ``%``.
* A missing column is null, a missing table an error; names fold to lower case, quoted ones too.
* ``union`` keeps repeats, as ``union all`` does; columns match by name and are those of the left side.
* ``a join b using (k)`` keeps, of the right rows with the same key, the last; nulls match nulls.
* ``order by`` sees the input rows, not the aliases of the select list; nulls come last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ParseError(ValueError):
    """The text is no query of the dialect."""


KEYWORDS = frozenset("select from where case when else end as in then join union is not null and or order by asc desc values using all between like".split())
_LEX = re.compile(
    r"""\s+|--[^\n]*
    |(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |'(?P<str>(?:[^']|'')*)'(?:::[A-Za-z_]\w*)?
    |"(?P<quoted>[^"]*)"
    |!(?P<hole>\w+)!
    |(?P<word>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)
    |(?P<op>\|\||<>|!=|<=|>=|[=<>+\-*/(),])""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # num, str, name, key, op or end
    text: str


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _LEX.match(sql, at)
        if not m:
            raise ParseError(f"cannot read {sql[at : at + 20]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind is None:
            continue
        text = m[kind]
        if kind == "word":
            low = text.lower()
            out.append(Token("key" if low in KEYWORDS else "name", low))
        elif kind in ("quoted", "hole"):
            out.append(Token("name", text.lower()))
        else:
            out.append(Token(kind, text.replace("''", "'") if kind == "str" else text))
    if not out:
        raise ParseError("an empty query")
    return [*out, Token("end", "")]


# The tree: tuples whose first entry names the node.


class Parser:
    """Recursive descent; expressions by binding power, loosest first: or, and, not, atoms, ||, + -, * /."""

    _BINARY = {"||": 1, "+": 2, "-": 2, "*": 3, "/": 3}

    def __init__(self, sql: str):
        self.toks, self.i = tokens(sql), 0

    def peek(self, *texts: str) -> bool:
        t = self.toks[self.i]
        return t.kind in ("key", "op") and t.text in texts

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ParseError(f"expected {text!r} before {self.toks[self.i].text!r}")

    def name(self) -> str:
        t = self.toks[self.i]
        if t.kind != "name":
            raise ParseError(f"expected a name before {t.text!r}")
        self.i += 1
        return t.text

    def query(self):
        tree = self.union()
        if self.toks[self.i].kind != "end":
            raise ParseError(f"unexpected {self.toks[self.i].text!r}")
        return tree

    def union(self):
        left = self.part()
        while self.take("union"):
            self.take("all")
            left = ("union", left, self.part())
        return left

    def part(self):
        if self.take("("):
            inner = self.union()
            self.need(")")
            return inner
        self.need("select")
        if self.toks[self.i] == Token("name", "distinct"):
            raise ParseError("distinct is not part of the dialect")
        items = [("*",)] if self.take("*") else self.items()
        self.need("from")
        source = self.source()
        where = self.boolean() if self.take("where") else None
        order = []
        if self.take("order"):
            self.need("by")
            while True:
                e = self.value()
                down = self.take("desc")
                if not down:
                    self.take("asc")
                order.append((e, down))
                if not self.take(","):
                    break
        return ("select", items, source, where, order)

    def items(self):
        out = [self.item()]
        while self.take(","):
            out.append(self.item())
        return out

    def item(self):
        e = self.boolean()
        if self.take("as") or self.toks[self.i].kind == "name":
            return ("as", e, self.name())
        return e

    def source(self):
        left = self.simple_source()
        while self.take("join"):
            right = self.simple_source()
            self.need("using")
            cols = self.columns() if self.peek("(") else []
            left = ("join", left, right, cols)
        return left

    def columns(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def simple_source(self):
        if not self.take("("):
            return ("table", self.name())
        if self.take("values"):
            rows = [self.tuple_()]
            while self.take(","):
                rows.append(self.tuple_())
            self.need(")")
            if self.take("as") or self.toks[self.i].kind == "name":
                self.name()
            if not self.peek("("):
                raise ParseError("values need a list of column names")
            return ("values", rows, self.columns())
        mark = self.i
        depth = 0
        while self.toks[mark + depth].text == "(":
            depth += 1
        inner = self.union() if self.toks[mark + depth] == Token("key", "select") else self.source()
        self.need(")")
        if self.take("as") or self.toks[self.i].kind == "name":
            self.name()
        return inner

    def tuple_(self):
        self.need("(")
        out = [self.value()]
        while self.take(","):
            out.append(self.value())
        self.need(")")
        return out

    def boolean(self):
        left = self.conjunction()
        while self.take("or"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = ("and", left, self.negation())
        return left

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.condition()

    def condition(self):
        left = self.value()
        negated = self.peek("not") and self.toks[self.i + 1].text in ("in", "like", "between")
        if negated:
            self.i += 1
        if self.take("in"):
            node = ("in", left, self.tuple_())
        elif self.take("like"):
            node = ("like", left, self.value())
        elif self.take("between"):
            low = self.value()
            self.need("and")
            node = ("between", left, low, self.value())
        elif self.take("is"):
            negated = self.take("not")
            self.need("null")
            node = ("null?", left)
        elif self.peek("=", "<>", "!=", "<", ">", "<=", ">="):
            op = self.toks[self.i].text
            self.i += 1
            node = ("cmp", "<>" if op == "!=" else op, left, self.value())
        else:
            return left
        return ("not", node) if negated else node

    def value(self, power: int = 0):
        left = self.primary()
        while self.toks[self.i].kind == "op" and self._BINARY.get(self.toks[self.i].text, 0) > power:
            op = self.toks[self.i].text
            self.i += 1
            left = ("bin", op, left, self.value(self._BINARY[op]))
        return left

    def primary(self):
        t = self.toks[self.i]
        if self.take("("):
            inner = self.boolean()
            self.need(")")
            return inner
        if self.take("-"):
            inner = self.primary()
            return ("lit", "-" + inner[1], inner[2]) if inner[0] == "lit" and inner[2] in "IF" else ("bin", "-", ("lit", "0", "I"), inner)
        if self.take("null"):
            return ("lit", None, "N")
        if self.take("case"):
            whens, other = [], ("lit", None, "N")
            while self.take("when"):
                cond = self.boolean()
                self.need("then")
                whens.append((cond, self.value()))
            if self.take("else"):
                other = self.value()
            self.need("end")
            if not whens:
                raise ParseError("case needs a when")
            return ("case", whens, other)
        self.i += 1
        if t.kind == "num":
            return ("lit", t.text, "I" if t.text.isdigit() else "F")
        if t.kind == "str":
            return ("lit", t.text, "S")
        if t.kind == "name":
            if not self.take("("):
                return ("col", t.text)
            args = []
            if not self.take(")"):
                args = [self.boolean()]
                while self.take(","):
                    args.append(self.boolean())
                self.need(")")
            return ("call", t.text, args)
        raise ParseError(f"unexpected {t.text or 'end of the query'!r}")


@dataclass(frozen=True)
class Typed:
    """A column with its type in the dialect: S string, I integer, F float, B boolean, N null, G anything else."""

    kind: str
    col: Column


def _null() -> Typed:
    return Typed("N", F.lit(None))


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "S"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "I"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "F"
    return "B" if isinstance(t, T.BooleanType) else "N" if isinstance(t, T.NullType) else "G"


_PLAIN = {"S": "string", "I": "bigint", "F": "double", "B": "boolean", "N": "void"}


def _one_type(values: list[Typed]) -> tuple[str, list[Column]]:
    """One type for the branches of an expression: their own if they agree, else text."""
    kinds = {v.kind for v in values} - {"N"}
    if len(kinds) <= 1:
        kind = kinds.pop() if kinds else "N"
        return kind, [v.col if v.kind == kind or kind in "GN" else v.col.cast(_PLAIN[kind]) for v in values]
    return "S", [v.col.cast("string") for v in values]


class Lowering:
    """Expressions over the columns of one DataFrame."""

    def __init__(self, df: DataFrame, fix_strreplace: bool = False):
        self.cols = {}
        for f in df.schema.fields:
            if f.name.lower() not in self.cols:
                kind = _kind(f.dataType)
                col = F.col(f"`{f.name}`")
                self.cols[f.name.lower()] = Typed(kind, col.cast(_PLAIN[kind]) if kind in "IF" else col)
        self.fix_strreplace = fix_strreplace

    def value(self, node) -> Typed:
        what = node[0]
        if what == "col":
            return self.cols.get(node[1]) or _null()
        if what == "lit":
            _, text, kind = node
            return {"N": lambda: _null(), "I": lambda: Typed("I", F.lit(int(text)).cast("bigint")), "F": lambda: Typed("F", F.lit(float(text))), "S": lambda: Typed("S", F.lit(text))}[kind]()
        if what == "as":
            return self.value(node[1])
        if what == "bin":
            a, b = self.value(node[2]), self.value(node[3])
            return self.joined([a, b]) if node[1] == "||" else self.arithmetic(node[1], a, b)
        if what == "case":
            values = [self.value(v) for _, v in node[1]] + [self.value(node[2])]
            kind, cols = _one_type(values)
            out = None
            for (cond, _), col in zip(node[1], cols):
                out = F.when(self.test(cond), col) if out is None else out.when(self.test(cond), col)
            return Typed(kind, out.otherwise(cols[-1]))
        if what == "call":
            return self.call(node[1], node[2])
        return Typed("B", self.test(node))

    def test(self, node) -> Column:
        what = node[0]
        if what == "and":
            return self.test(node[1]) & self.test(node[2])
        if what == "or":
            return self.test(node[1]) | self.test(node[2])
        if what == "not":
            return ~self.test(node[1])
        if what == "cmp":
            return self.compare(node[1], self.value(node[2]), self.value(node[3]))
        if what == "between":
            v = self.value(node[1])
            return self.compare(">=", v, self.value(node[2])) & self.compare("<=", v, self.value(node[3]))
        if what == "in":
            v = self.value(node[1])
            if v.kind not in "SF":
                return F.lit(False)
            same = [x.col for x in map(self.value, node[2]) if x.kind == v.kind]
            return F.coalesce(v.col.isin(*same), F.lit(False)) if same else F.lit(False)
        if what == "like":
            v, p = self.value(node[1]), self.value(node[2])
            if v.kind != "S" or p.kind != "S":
                return F.lit(False)
            prefix = F.call_function("left", p.col, F.char_length(p.col) - 1)
            return F.coalesce(p.col.endswith("%") & v.col.startswith(prefix), F.lit(False))
        if what == "null?":
            return self.value(node[1]).col.isNull()
        v = self.value(node)
        if v.kind == "B":
            return F.coalesce(v.col, F.lit(False))
        raise ParseError("a condition must be a predicate")

    @staticmethod
    def compare(op: str, a: Typed, b: Typed) -> Column:
        if a.kind != b.kind or a.kind not in "SIF":
            return F.lit(False)
        test = {"=": a.col == b.col, "<>": a.col != b.col, "<": a.col < b.col, ">": a.col > b.col, "<=": a.col <= b.col, ">=": a.col >= b.col}[op]
        return F.coalesce(test, F.lit(False))

    @staticmethod
    def joined(parts: list[Typed]) -> Typed:
        return Typed("S", F.concat(*[p.col for p in parts])) if parts and all(p.kind == "S" for p in parts) else _null()

    @staticmethod
    def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
        """Two integers stay integer and wrap; a float makes a float; on the right, text counts as 0.0."""
        if a.kind not in "IF" or b.kind in "NG":
            return _null()
        if a.kind == b.kind == "I":
            if op == "/":
                return Typed("I", F.when(b.col != 0, _int_div(a.col, b.col)))
            # Beyond 64 bits the result wraps: taken exactly, then brought back into range.
            wide = lambda c: c.cast("decimal(20,0)")
            exact = {"+": wide(a.col) + wide(b.col), "-": wide(a.col) - wide(b.col), "*": wide(a.col) * wide(b.col)}[op]
            quick = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col, b.col)
            turn = F.lit("18446744073709551616").cast("decimal(38,0)")
            half = F.lit("9223372036854775808").cast("decimal(38,0)")
            wrapped = (F.pmod(exact.cast("decimal(38,0)") + half, turn) - half).cast("bigint")
            return Typed("I", F.coalesce(quick, wrapped))
        x, y = a.col.cast("double"), b.col.cast("double") if b.kind in "IF" else F.when(b.col.isNotNull(), F.lit(0.0))
        if op == "/":
            by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
            return Typed("F", F.when(y == 0, by_zero).otherwise(F.try_divide(x, y)))
        return Typed("F", {"+": x + y, "-": x - y, "*": x * y}[op])

    def call(self, name: str, nodes) -> Typed:
        args = [self.value(n) for n in nodes]
        kinds = "".join(a.kind for a in args)
        cols = [a.col for a in args]
        if name == "coalesce" and args:
            kind, same = _one_type(args)
            return Typed(kind, F.coalesce(*same))
        if name == "nullif" and len(args) == 2:
            return Typed(args[0].kind, F.when(~self.compare("=", *args), cols[0]))
        if name == "strreplace" and kinds == "SSS" and self.fix_strreplace:
            return Typed("S", F.replace(*cols))
        if name == "numchar" and kinds == "SS":
            s, c = cols
            n = F.when(c == "", F.char_length(s) + 1).otherwise(_int_div(F.octet_length(s) - F.octet_length(F.replace(s, c, F.lit(""))), F.greatest(F.octet_length(c), F.lit(1))))
            return Typed("I", n.cast("bigint"))
        if name == "maxwidth" and kinds in ("S", "SS"):
            s, sep = cols[0], cols[1] if len(cols) == 2 else F.lit("\n")
            pieces = F.split(F.replace(s, sep, F.lit("\x00")), "\x00", -1)
            return Typed("I", F.when((s != "") & (sep != ""), F.array_max(F.transform(pieces, F.octet_length))).cast("bigint"))
        if name == "makeinteger" and len(args) == 1:
            if kinds != "S":
                return Typed("I", F.lit(0).cast("bigint"))
            plain = F.regexp_replace(cols[0], "::.*$", "")
            return Typed("I", F.coalesce(F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint")), F.lit(0)).cast("bigint"))
        if name == "makefloat" and len(args) == 1:
            if kinds != "S":
                return Typed("F", F.lit(0.0))
            plain = F.regexp_replace(cols[0], "::.*$", "")
            return Typed("F", F.coalesce(F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double")), F.lit(0.0)))
        if name in ("char_length", "length") and len(args) == 1:
            return Typed("I", F.coalesce(F.octet_length(cols[0]), F.lit(0)).cast("bigint") if kinds == "S" else F.lit(0).cast("bigint"))
        if name == "substr" and kinds == "SII":
            s, start, n = cols
            n = F.when(start == 0, n - 1).otherwise(n)
            start = F.when(start == 0, F.lit(1)).otherwise(start)
            fits = (start >= 1) & (n > 0) & (start + n - 1 <= F.octet_length(s))
            return Typed("S", F.when(fits, F.make_valid_utf8(F.substring(s.cast("binary"), start.cast("int"), n.cast("int")).cast("string"))))
        if name == "concat":
            return self.joined(args)
        return _null()


def _int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _name_of(node, i: int) -> str:
    return node[2] if node[0] == "as" else node[1] if node[0] == "col" else f"expr_{i}"


class Planner:
    def __init__(self, tables: dict[str, DataFrame], ordinals: dict[str, str] | None = None, fix_strreplace: bool = False):
        self.tables, self.ordinals, self.fix = {k.lower(): v for k, v in tables.items()}, ordinals or {}, fix_strreplace

    def plan(self, node) -> DataFrame:
        what = node[0]
        if what == "table":
            if node[1] not in self.tables:
                raise ParseError(f"no table {node[1]}")
            df = self.tables[node[1]]
            seen: dict[str, Column] = {}
            for c in df.columns:
                seen.setdefault(c.lower(), F.col(f"`{c}`").alias(c.lower()))
            return df.select(*seen.values())
        if what == "values":
            return self.values(node[1], node[2])
        if what == "union":
            return self.union(self.plan(node[1]), self.plan(node[2]))
        if what == "join":
            return self.join(node)
        _, items, source, where, order = node
        df = self.plan(source)
        low = Lowering(df, self.fix)
        if where is not None:
            df = df.where(low.test(where))
        if order:
            keys = [low.value(e) for e, _ in order]
            df = df.orderBy(*[k.col.desc_nulls_last() if down else k.col.asc_nulls_last() for k, (_, down) in zip(keys, order) if k.kind not in "GN"])
        if items == [("*",)]:
            return df
        out: dict[str, Column] = {}
        for i, e in enumerate(items, 1):
            out.setdefault(_name_of(e, i), low.value(e).col.alias(_name_of(e, i)))
        return df.select(*out.values())

    def values(self, rows, names: list[str]) -> DataFrame:
        spark = next(iter(self.tables.values())).sparkSession
        empty = Lowering(spark.range(0), self.fix)
        typed = [[empty.value(v) for v in row] for row in rows]
        width = max(map(len, typed))
        columns = [_one_type([r[i] if i < len(r) else _null() for r in typed]) for i in range(min(width, len(names)))]
        structs = [F.struct(*[cols[k].alias(n) for n, (_, cols) in zip(names, columns)]) for k in range(len(rows))]
        return spark.range(1).select(F.inline(F.array(*structs)))

    @staticmethod
    def union(left: DataFrame, right: DataFrame) -> DataFrame:
        kinds = {f.name: _kind(f.dataType) for f in right.schema.fields}
        for f in left.schema.fields:
            k = _kind(f.dataType)
            if f.name in kinds and "N" not in (k, kinds[f.name]) and k != kinds[f.name]:
                left = left.withColumn(f.name, F.col(f"`{f.name}`").cast("string"))
                right = right.withColumn(f.name, F.col(f"`{f.name}`").cast("string"))
        keep = [c for c in right.columns if c in left.columns]
        return left.unionByName(right.select(*[F.col(f"`{c}`") for c in keep]), allowMissingColumns=True).select(*[F.col(f"`{c}`") for c in left.columns])

    def join(self, node) -> DataFrame:
        _, l, r, keys = node
        left, right = self.plan(l), self.plan(r)
        lk, rk = Lowering(left, self.fix), Lowering(right, self.fix)
        able = bool(keys) and all(k in lk.cols and k in rk.cols and lk.cols[k].kind == rk.cols[k].kind and lk.cols[k].kind in "SIFB" for k in keys)
        text = lambda t: F.round(t.col, 5) if t.kind == "F" else t.col
        ordinal = self.ordinals.get(r[1]) if r[0] == "table" else None
        by = [F.col(f"`{ordinal}`").desc_nulls_last()] if ordinal else [F.col(f"`{c}`").desc_nulls_last() for c in right.columns if _kind(right.schema[c].dataType) in "SIFB"]
        names = [c for c in right.columns if c not in left.columns]
        if not able:
            return left.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in names]).where(F.lit(False))
        kept = right.select(*[text(rk.cols[k]).alias(f"key_{i}__") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns])
        # The last row per key; with an ordinal one pass of max_by, so a hot key is combined before it moves.
        keyed = [f"key_{i}__" for i in range(len(keys))]
        if ordinal:
            last = kept.groupBy(*keyed).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in right.columns]), F.col(f"`{ordinal}`")).alias("row__"))
            last = last.select(*keyed, *[F.col(f"row__.`{c}`").alias(c) for c in names])
        else:
            window = Window.partitionBy(*keyed).orderBy(*by)
            last = kept.withColumn("nth__", F.row_number().over(window)).where("nth__ = 1").select(*keyed, *names)
        cond = None
        for i, k in enumerate(keys):
            c = text(lk.cols[k]).eqNullSafe(F.col(f"key_{i}__"))
            cond = c if cond is None else cond & c
        return left.join(last, cond).drop(*keyed)


def run(sql: str, tables: dict[str, DataFrame], ordinals: dict[str, str] | None = None, fix_strreplace: bool = False) -> DataFrame:
    """The result of a query of the dialect over ``tables``.

    ``ordinals`` names, for a table on the right of a join, the column whose greatest value makes a row the last of its
    key; without one the greatest row counts as the last, so the result never depends on how the table lies.
    ``fix_strreplace`` makes ``strreplace`` replace; otherwise it gives null, as the dialect always had it.
    """
    return Planner(tables, ordinals, fix_strreplace).plan(Parser(sql).query())
