"""The PostgreSQL-flavoured dialect, translated to Spark SQL text.

A tokenizer and a precedence parser rewrite what differs (casts, integer division, vector operators,
null order, quantified comparisons, string functions, output names) and pass the rest through, so that
Catalyst still sees one declarative query.  Types are only needed for ``/`` and casts to integers: their
operands are analysed (never executed) against the FROM clause at hand.
"""

from __future__ import annotations

import re

TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|(?P<str>'(?:[^']|'')*')|(?P<id>\"(?:[^\"]|\"\")*\")|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<par>\$\d+)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<op><->|<=>|<#>|::|<>|!=|<=|>=|\|\||[-+*/%=<>(),.;\[\]])", re.S)

TYPES = {"bool": "boolean", "boolean": "boolean", "int2": "smallint", "smallint": "smallint", "int4": "int", "int": "int", "integer": "int", "serial": "int", "int8": "bigint", "bigint": "bigint", "bigserial": "bigint", "float4": "float", "real": "float", "float8": "double", "double": "double", "numeric": "double", "decimal": "double", "text": "string", "varchar": "string", "character": "string", "char": "string", "bytea": "binary", "vector": "array<float>", "date": "date", "timestamp": "timestamp"}
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
VECTOR_OPS = {"<->": "l2", "<=>": "cosine", "<#>": "ip"}
CLAUSES = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "RETURNING", "ON", "AND", "OR", "THEN", "WHEN", "ELSE", "END", "AS", "ASC", "DESC", "NULLS", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "USING", "SET", "VALUES", "WINDOW", "FETCH", "FOR"}


class DialectError(ValueError):
    """Text that the dialect does not know."""


def tokenize(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise DialectError(f"syntax error at {sql[at:at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


def string(value: str) -> str:
    """A Spark literal of a text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Translator:
    """Reads one statement's tokens; methods return Spark SQL text.

    schema_of: Spark SQL query text -> the type name of its first column, or None where it can't be analysed.
    relation: (schema, name) of a table -> the text that Spark knows it by.
    """

    def __init__(self, tokens, schema_of, relation, params=()):
        self.t, self.i, self.schema_of, self.relation, self.params = tokens, 0, schema_of, relation, params
        self.scopes: list[str] = []

    # tokens

    def peek(self, ahead: int = 0) -> str:
        j = self.i + ahead
        return self.t[j][1].upper() if j < len(self.t) and self.t[j][0] in ("word", "op") else ""

    def kind(self, ahead: int = 0) -> str:
        j = self.i + ahead
        return self.t[j][0] if j < len(self.t) else ""

    def take(self) -> str:
        if self.i >= len(self.t):
            raise DialectError("syntax error at end of input")
        self.i += 1
        return self.t[self.i - 1][1]

    def accept(self, *words: str) -> bool:
        if all(self.peek(n) == w for n, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise DialectError(f"syntax error at or near {self.t[self.i][1] if self.i < len(self.t) else 'end'!r}: expected {' '.join(words)}")

    def name(self) -> str:
        kind, text = self.kind(), self.take()
        if kind == "id":
            return text[1:-1].replace('""', '"')
        if kind != "word":
            raise DialectError(f"syntax error at or near {text!r}")
        return text.lower()

    @staticmethod
    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def table_name(self) -> tuple[str, str]:
        first = self.name()
        return (first, self.name()) if self.accept(".") else ("public", first)

    # queries

    def query(self) -> str:
        lead = ""
        if self.accept("WITH"):
            recursive = "RECURSIVE " if self.accept("RECURSIVE") else ""
            parts = []
            while True:
                n = self.name()
                columns = self.name_list() if self.peek() == "(" else ""
                self.expect("AS", "(")
                self.ctes = getattr(self, "ctes", set()) | {n}
                parts.append(f"{self.quoted(n)}{columns} AS ({self.query()})")
                self.expect(")")
                if not self.accept(","):
                    break
            lead = f"WITH {recursive}{', '.join(parts)} "
            self.leads = getattr(self, "leads", "") or lead
        text = self.set_operand()
        while self.peek() in ("UNION", "INTERSECT", "EXCEPT"):
            op = self.take().upper()
            op += " ALL" if self.accept("ALL") else ""
            self.accept("DISTINCT")
            text = f"{text} {op} {self.set_operand()}"
        return lead + text + self.tail()

    def name_list(self) -> str:
        self.expect("(")
        out = [self.quoted(self.name())]
        while self.accept(","):
            out.append(self.quoted(self.name()))
        self.expect(")")
        return f"({', '.join(out)})"

    def tail(self) -> str:
        out = ""
        if self.accept("ORDER", "BY"):
            out += " ORDER BY " + ", ".join(self.sort_keys())
        limit = offset = ""
        while self.peek() in ("LIMIT", "OFFSET"):
            if self.take().upper() == "LIMIT":
                limit = "" if self.accept("ALL") else f" LIMIT {self.expression()}"
            else:
                offset = f" OFFSET {self.expression()}"
        return out + limit + offset

    def sort_keys(self) -> list[str]:
        out = []
        while True:
            key = self.take() if self.kind() == "num" and self.peek(1) in ("", ",", "ASC", "DESC", "NULLS", "LIMIT", "OFFSET", ")") else self.expression()
            down = self.accept("DESC")
            self.accept("ASC")
            nulls = "FIRST" if down else "LAST"
            if self.accept("NULLS"):
                nulls = self.take().upper()
            out.append(f"{key} {'DESC' if down else 'ASC'} NULLS {nulls}")
            if not self.accept(","):
                return out

    def set_operand(self) -> str:
        if self.accept("("):
            text = self.query()
            self.expect(")")
            return f"({text})"
        if self.accept("VALUES"):
            return "VALUES " + ", ".join(self.rows())
        return self.select()

    def rows(self) -> list[str]:
        out = []
        while True:
            self.expect("(")
            out.append(f"({', '.join(self.expressions())})")
            self.expect(")")
            if not self.accept(","):
                return out

    def from_text(self) -> str:
        """The FROM clause that begins somewhere ahead in this select, translated without moving."""
        depth, j = 0, self.i
        while j < len(self.t):
            text = self.t[j][1].upper() if self.t[j][0] in ("word", "op") else ""
            if text == "(":
                depth += 1
            elif text == ")":
                depth -= 1
                if depth < 0:
                    break
            elif depth == 0 and text in ("UNION", "INTERSECT", "EXCEPT", "ORDER", "LIMIT", ";"):
                break
            elif depth == 0 and text == "FROM":
                if self.t[j - 1][1].upper() == "DISTINCT" and self.t[j - 2][1].upper() in ("IS", "NOT"):
                    j += 1
                    continue
                at, self.i = self.i, j + 1
                self.scopes.append("")
                out = " FROM " + self.sources()
                self.scopes.pop()
                self.i = at
                return out
            j += 1
        return ""

    def select(self) -> str:
        self.expect("SELECT")
        self.scopes.append(self.from_text())
        out = "SELECT "
        on = None
        if self.accept("DISTINCT"):
            if self.accept("ON", "("):
                on = self.expressions()
                self.expect(")")
            else:
                out += "DISTINCT "
        else:
            self.accept("ALL")
        items = self.items()
        rest = ""
        if self.accept("FROM"):
            rest += " FROM " + self.sources()
        if self.accept("WHERE"):
            rest += " WHERE " + self.expression()
        if self.accept("GROUP", "BY"):
            rest += " GROUP BY " + (self.grouping_sets() if self.accept("GROUPING", "SETS", "(") else ", ".join(self.expressions(ordinals=True)))
        if self.accept("HAVING"):
            rest += " HAVING " + self.expression()
        if on is not None:  # the first row of each key in the query's order
            ordered = self.accept("ORDER", "BY")
            keys = self.sort_keys() if ordered else [f"{x} ASC NULLS LAST" for x in on]
            keys = [re.sub(r"^\d+(?= )", lambda m: f"({re.sub(r' AS `[^`]*`$', '', items[int(m[0]) - 1])})", k) for k in keys]
            sorts = [k.rsplit(" ", 3) for k in keys]  # the key, its direction and its nulls
            places = ", ".join(f"{x[0]} AS `__k{n}`" for n, x in enumerate(sorts))
            inner = f"SELECT {', '.join(items)}, row_number() OVER (PARTITION BY {', '.join(on)} ORDER BY {', '.join(keys)}) AS `__n`, {places}{rest}"
            self.scopes.pop()
            order = " ORDER BY " + ", ".join(f"`__k{n}` {' '.join(x[1:])}" for n, x in enumerate(sorts)) if ordered else ""
            hidden = ", ".join(["`__n`", *(f"`__k{n}`" for n in range(len(sorts)))])
            return f"SELECT * EXCEPT ({hidden}) FROM ({inner}) WHERE `__n` = 1{order}"
        self.scopes.pop()
        return out + ", ".join(items) + rest

    def grouping_sets(self) -> str:
        out = []
        while True:
            if self.accept("(", ")"):
                out.append("()")
            elif self.accept("("):
                out.append(f"({', '.join(self.expressions())})")
                self.expect(")")
            else:
                out.append(f"({self.expression()})")
            if not self.accept(","):
                self.expect(")")
                return f"GROUPING SETS ({', '.join(out)})"

    def items(self) -> list[str]:
        out = []
        while True:
            if self.accept("*"):
                out.append("*")
            elif self.kind() in ("word", "id") and self.peek(1) == "." and self.peek(2) == "*":
                out.append(self.quoted(self.name()) + ".*")
                self.i += 2
            else:
                at = self.i
                text = self.expression()
                if self.accept("AS") or self.kind() == "id" or self.kind() == "word" and self.peek() not in CLAUSES:
                    text += f" AS {self.quoted(self.name())}"
                else:
                    words = self.t[at : self.i]
                    plain = all(k in ("word", "id") or x == "." for k, x in words) and words[-1][1].upper() not in ("NULL", "TRUE", "FALSE")
                    called = words[0][0] == "word" and len(words) > 2 and words[1][1] == "(" and words[0][1].upper() not in ("CASE", "CAST") and self.closes(words)
                    if not plain:
                        text += f" AS {self.quoted(words[0][1].lower() if called else '?column?')}"
                out.append(text)
            if not self.accept(","):
                return out

    @staticmethod
    def closes(words) -> bool:
        depth = 0
        for n, (_, x) in enumerate(words):
            depth += (x == "(") - (x == ")")
            if n and depth == 0:
                return n == len(words) - 1
        return False

    def sources(self) -> str:
        out = self.joined()
        while self.accept(","):
            out += " CROSS JOIN " + self.joined()
        return out

    def joined(self) -> str:
        out = self.source()
        while True:
            natural = "NATURAL " if self.accept("NATURAL") else ""
            if self.accept("CROSS", "JOIN"):
                out += " CROSS JOIN " + self.source()
                continue
            side = "INNER"
            if self.peek() in ("INNER", "LEFT", "RIGHT", "FULL"):
                side = self.take().upper()
                self.accept("OUTER")
                self.expect("JOIN")
            elif not self.accept("JOIN"):
                return out
            out += f" {natural}{side} JOIN {self.source()}"
            if self.accept("ON"):
                out += " ON " + self.expression()
            elif self.accept("USING"):
                out += " USING " + self.name_list()

    def source(self) -> str:
        lateral = "LATERAL " if self.accept("LATERAL") else ""
        if self.accept("("):
            if self.peek() in ("SELECT", "VALUES", "WITH", "("):
                text = f"{lateral}({self.query()})"
            else:
                text = f"({self.sources()})"
            self.expect(")")
            alias = self.alias()
            if not alias and text[1:7] == "SELECT":
                raise DialectError("subquery in FROM must have an alias")
            return text + alias
        schema, name = self.table_name()
        if name in getattr(self, "ctes", ()) and schema == "public":
            return self.quoted(name) + self.alias()
        return self.relation(schema, name) + (self.alias() or f" AS {self.quoted(name)}")

    def alias(self) -> str:
        if self.accept("AS") or self.kind() == "id" or self.kind() == "word" and self.peek() not in CLAUSES:
            text = f" AS {self.quoted(self.name())}"
            return text + (self.name_list() if self.peek() == "(" else "")
        return ""

    # expressions

    def expressions(self, ordinals: bool = False) -> list[str]:
        out = []
        while True:
            out.append(self.take() if ordinals and self.kind() == "num" else self.expression())
            if not self.accept(","):
                return out

    def type_of(self, text: str) -> str | None:
        for scope in reversed(self.scopes or [""]):
            found = self.schema_of(f"{getattr(self, 'leads', '')}SELECT {text}{scope}")
            if found:
                return found
        return None

    def expression(self, least: int = 0) -> str:
        left = self.prefix()
        while True:
            op = self.peek()
            negated = op == "NOT" and self.peek(1) in ("IN", "LIKE", "ILIKE", "BETWEEN", "SIMILAR")
            word = self.peek(1) if negated else op
            power = {"OR": 1, "AND": 2, "IS": 4, "ISNULL": 4, "NOTNULL": 4, "=": 5, "<>": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "IN": 6, "LIKE": 6, "ILIKE": 6, "BETWEEN": 6, "||": 7, "<->": 7, "<=>": 7, "<#>": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9, "::": 12}.get(word, 0)
            if power <= least:
                return left
            self.i += 1 + negated
            no = "NOT " if negated else ""
            if word == "::":
                left = self.cast(left, self.type_name())
            elif word == "IS":
                no = "NOT " if self.accept("NOT") else ""
                if self.accept("DISTINCT", "FROM"):
                    same = f"({left} <=> {self.expression(5)})"
                    left = same if no else f"(NOT {same})"
                else:
                    left = f"({left} IS {no}{self.take().upper()})"
            elif word in ("ISNULL", "NOTNULL"):
                left = f"({left} IS {'NOT ' if word == 'NOTNULL' else ''}NULL)"
            elif word == "IN":
                self.expect("(")
                inner = self.query() if self.peek() in ("SELECT", "WITH", "VALUES") else ", ".join(self.expressions())
                self.expect(")")
                left = f"({left} {no}IN ({inner}))"
            elif word == "BETWEEN":
                low = self.expression(6)
                self.expect("AND")
                left = f"({no}({left} >= {low} AND {left} <= {self.expression(6)}))"
            elif word in ("LIKE", "ILIKE"):
                left = f"({left} {no}{word} {self.expression(6)})"
            elif word in VECTOR_OPS:
                left = self.distance(VECTOR_OPS[word], left, self.expression(7))
            elif power == 5 and self.peek() in ("ALL", "ANY", "SOME") and self.peek(1) == "(":
                left = self.quantified(left, "<>" if word == "!=" else word, self.take().upper())
            elif word == "/":
                right = self.expression(9)
                whole = self.type_of(left) in INTEGRAL and self.type_of(right) in INTEGRAL
                left = f"({left} div {right})" if whole else f"({left} / {right})"
            elif word == "||":
                left = f"(CAST({left} AS STRING) || CAST({self.expression(7)} AS STRING))"
            else:
                left = f"({left} {word} {self.expression(power)})"

    def quantified(self, x: str, op: str, kind: str) -> str:
        """x op ALL/ANY (subquery) from the subquery's extremes and counts, in three-valued logic."""
        self.expect("(")
        sub = self.query()
        self.expect(")")
        some = kind != "ALL"
        if op == "=" and some:
            return f"({x} IN ({sub}))"
        if op == "<>" and not some:
            return f"({x} NOT IN ({sub}))"
        v = "`__q`.`__v`"
        pick = lambda f: f"(SELECT {f} FROM ({sub}) AS `__q`(`__v`))"
        low, high, n, known = pick(f"min({v})"), pick(f"max({v})"), pick("count(*)"), pick(f"count({v})")
        if some:
            hit = {">": f"{x} > {low}", ">=": f"{x} >= {low}", "<": f"{x} < {high}", "<=": f"{x} <= {high}", "<>": f"({x} <> {low} OR {x} <> {high})"}[op]
            return f"(CASE WHEN {n} = 0 THEN FALSE WHEN {x} IS NULL THEN NULL WHEN {hit} THEN TRUE WHEN {known} < {n} THEN NULL ELSE FALSE END)"
        miss = {">": f"NOT ({x} > {high})", ">=": f"NOT ({x} >= {high})", "<": f"NOT ({x} < {low})", "<=": f"NOT ({x} <= {low})", "=": f"({x} <> {low} OR {x} <> {high})"}[op]
        return f"(CASE WHEN {n} = 0 THEN TRUE WHEN {x} IS NULL THEN NULL WHEN {miss} THEN FALSE WHEN {known} < {n} THEN NULL ELSE TRUE END)"

    @staticmethod
    def vector(text: str) -> str:
        m = re.fullmatch(r"'(\[[^\]]*\])'", text)
        if not m:
            return text
        try:
            values = [float(v) for v in m[1][1:-1].split(",")]
        except ValueError:
            raise DialectError(f"invalid input syntax for type vector: {m[1]}") from None
        if any(v != v or abs(v) == float("inf") for v in values):
            raise DialectError(f"vector elements must be finite: {m[1]}")
        return f"array({', '.join(f'CAST({v!r}D AS FLOAT)' for v in values)})"

    def distance(self, metric: str, a: str, b: str) -> str:
        a, b = self.vector(a), self.vector(b)
        total = lambda p, q, f: f"aggregate(zip_with({p}, {q}, (x, y) -> {f}), 0D, (s, x) -> s + x)"
        dot = lambda p, q: total(p, q, "CAST(x AS DOUBLE) * y")
        if metric == "l2":
            value = f"sqrt({total(a, b, '(CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)')})"
        elif metric == "ip":
            value = f"(-{dot(a, b)})"
        else:
            norms = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
            value = f"(CASE WHEN {norms} = 0 THEN 1D ELSE 1D - {dot(a, b)} / {norms} END)"
        return f"(CASE WHEN size({a}) <> size({b}) THEN CAST(raise_error('different vector dimensions') AS DOUBLE) ELSE {value} END)"

    def type_name(self) -> str:
        word = self.name()
        self.accept("PRECISION") or self.accept("VARYING")
        if self.accept("("):
            while not self.accept(")"):
                self.take()
        if word not in TYPES:
            raise DialectError(f'type "{word}" does not exist')
        return TYPES[word]

    def cast(self, text: str, to: str) -> str:
        if to == "array<float>":
            return self.vector(text) if text.startswith("'") else f"from_json({text}, 'array<float>')"
        if to in INTEGRAL and self.type_of(text) in ("float", "double") or to in INTEGRAL and re.fullmatch(r"\d+\.\d*|CAST\(.* AS DOUBLE\)", text):
            return f"CAST(round({text}, 0) AS {to})"
        if to == "boolean" and self.type_of(text) == "string":
            return f"(CASE lower(trim({text})) WHEN 'on' THEN TRUE WHEN 'off' THEN FALSE ELSE CAST({text} AS BOOLEAN) END)"
        return f"CAST({text} AS {to})"

    def prefix(self) -> str:
        kind, op = self.kind(), self.peek()
        if op == "NOT":
            self.i += 1
            return f"(NOT {self.expression(3)})"
        if op in ("-", "+"):
            self.i += 1
            return f"({op}{self.expression(10)})"
        if op == "(":
            self.i += 1
            if self.peek() in ("SELECT", "WITH", "VALUES"):
                text = f"({self.query()})"
            else:
                parts = self.expressions()
                text = f"({', '.join(parts)})"
            self.expect(")")
            return text
        if op == "CASE":
            return self.case()
        if kind == "str":
            return string(self.take()[1:-1].replace("''", "'"))
        if kind == "num":
            text = self.take()
            return text if text.isdigit() else f"CAST({text} AS DOUBLE)"
        if kind == "par":
            return self.parameter(int(self.take()[1:]))
        if op in ("NULL", "TRUE", "FALSE"):
            return self.take().upper()
        if op == "EXISTS":
            self.i += 1
            self.expect("(")
            text = f"EXISTS ({self.query()})"
            self.expect(")")
            return text
        if op in ("DATE", "TIMESTAMP", "INTERVAL") and self.kind(1) == "str":
            return f"{self.take().upper()} {string(self.take()[1:-1])}"
        if kind in ("word", "id") and (kind == "id" or op not in CLAUSES - {"LEFT", "RIGHT"}):
            if self.peek(1) == "(" and kind == "word":
                return self.call(self.name())
            parts = [self.quoted(self.name())]
            while self.accept("."):
                parts.append(self.quoted(self.name()))
            return ".".join(parts)
        raise DialectError(f"syntax error at or near {self.t[self.i][1] if self.i < len(self.t) else 'end of input'!r}")

    def parameter(self, n: int) -> str:
        if not 1 <= n <= len(self.params):
            raise DialectError(f"there is no parameter ${n}")
        v = self.params[n - 1]
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return str(v) if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)"
        return self.vector("'[" + ",".join(map(str, v)) + "]'") if isinstance(v, (list, tuple)) else string(str(v))

    def case(self) -> str:
        self.expect("CASE")
        out = "CASE" + ("" if self.peek() == "WHEN" else f" {self.expression()}")
        while self.accept("WHEN"):
            out += f" WHEN {self.expression()}"
            self.expect("THEN")
            out += f" THEN {self.expression()}"
        if self.accept("ELSE"):
            out += f" ELSE {self.expression()}"
        self.expect("END")
        return f"({out} END)"

    def call(self, f: str) -> str:
        self.expect("(")
        if f == "cast":
            text = self.expression()
            self.expect("AS")
            to = self.type_name()
            self.expect(")")
            return self.cast(text, to)
        if f in ("trim", "btrim", "ltrim", "rtrim"):
            return self.trim(f)
        if f == "position":
            part = self.expression(6)
            self.expect("IN")
            whole = self.expression()
            self.expect(")")
            return f"instr({whole}, {part})"
        if f in ("extract",):
            field = self.name()
            self.expect("FROM")
            text = self.expression()
            self.expect(")")
            return f"extract({field} FROM {text})"
        if f in ("substring", "substr"):
            args = [self.expression()]
            if self.accept("FROM"):
                args.append(self.expression())
                args += [self.expression()] if self.accept("FOR") else []
            elif self.accept(","):
                args += self.expressions()
            self.expect(")")
            start = f"greatest({args[1]}, 1)"
            length = f"greatest(greatest({args[1]} + {args[2]}, 1) - {start}, 0)" if len(args) > 2 else f"length({args[0]})"
            return f"substring({args[0]}, {start}, {length})"
        if f == "count" and self.accept("*"):
            self.expect(")")
            return self.window("count(*)")
        distinct = "DISTINCT " if self.accept("DISTINCT") else ""
        args = [] if self.peek() == ")" else self.expressions()
        keys = self.sort_keys() if self.accept("ORDER", "BY") else []
        self.expect(")")
        if f == "string_agg":
            order = f" WITHIN GROUP (ORDER BY {', '.join(keys)})" if keys else ""
            delimiter = args[1] if len(args) > 1 else "', '"
            return self.window(f"listagg({distinct}CAST({args[0]} AS STRING), {delimiter}){order}")
        return self.window(self.function(f, args, distinct))

    def window(self, text: str) -> str:
        if self.accept("FILTER", "(", "WHERE"):
            text += f" FILTER (WHERE {self.expression()})"
            self.expect(")")
        if not self.accept("OVER"):
            return text
        self.expect("(")
        parts = []
        if self.accept("PARTITION", "BY"):
            parts.append("PARTITION BY " + ", ".join(self.expressions()))
        if self.accept("ORDER", "BY"):
            parts.append("ORDER BY " + ", ".join(self.sort_keys()))
        while self.peek() != ")":
            parts.append(self.take())
        self.expect(")")
        return f"{text} OVER ({' '.join(parts)})"

    def trim(self, f: str) -> str:
        side = {"ltrim": "LEADING", "rtrim": "TRAILING"}.get(f, "BOTH")
        if self.peek() in ("LEADING", "TRAILING", "BOTH"):
            side = self.take().upper()
        chars = "' '"
        text = "" if self.peek() == "FROM" else self.expression()
        if self.accept("FROM"):
            chars, text = text or chars, self.expression()
        elif self.accept(","):
            chars = self.expression()
        self.expect(")")
        return f"trim({side} {chars} FROM {text})"

    def function(self, f: str, a: list[str], distinct: str = "") -> str:
        if f == "concat":
            return f"concat_ws('', {', '.join(f'CAST({x} AS STRING)' for x in a)})"
        if f == "strpos":
            return f"instr({a[0]}, {a[1]})"
        if f == "left":
            return f"substring({a[0]}, 1, CASE WHEN {a[1]} >= 0 THEN {a[1]} ELSE greatest(length({a[0]}) + {a[1]}, 0) END)"
        if f == "right":
            size = f"(CASE WHEN {a[1]} >= 0 THEN least({a[1]}, length({a[0]})) ELSE greatest(length({a[0]}) + {a[1]}, 0) END)"
            return f"substring({a[0]}, length({a[0]}) - {size} + 1, {size})"
        if f == "round":
            if len(a) == 1:
                return f"round({a[0]}, 0)"
            return f"(signum({a[0]}) * floor(abs({a[0]}) * power(10, {a[1]}) + 0.5D) / power(10, {a[1]}))"
        if f in ("power", "pow", "sqrt"):
            value = f"{'sqrt' if f == 'sqrt' else 'power'}({', '.join(f'CAST({x} AS DOUBLE)' for x in a)})"
            return value
        if f == "mod":
            return f"({a[0]} % {a[1]})"
        if f in ("nextval", "currval", "setval"):
            return self.sequence(f, a)
        return f"{f}({distinct}{', '.join(a)})"

    def sequence(self, f: str, a: list[str]) -> str:
        raise DialectError(f"{f} is not allowed here")
