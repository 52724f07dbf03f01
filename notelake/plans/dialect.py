"""The few expressions that Spark SQL and the checking engine write differently."""

from __future__ import annotations

from types import SimpleNamespace

from .parameters import checked


class Dialect:
    """p: the parameters of the statement that is compiled."""

    def __init__(self, **params):
        self.p = SimpleNamespace(**checked(params))

    @staticmethod
    def num(x) -> str:
        """A double's literal."""
        return f"CAST({float(x)!r} AS DOUBLE)"


class Spark(Dialect):
    name = "spark"

    def held(self, x, order):
        """All x of a group in order, as an array."""
        return f"transform(array_sort(collect_list(struct({order} AS o, {x} AS x))), y -> y.x)"

    def array_at(self, array, pos, x):
        return f"LATERAL VIEW posexplode({array}) u_{x} AS {pos}, {x}"

    def rint(self, x):
        return f"rint({x})"

    def div(self, a, b):
        return f"(({a}) div ({b}))"

    def series(self, a, b, i):
        """A lateral clause: i runs from a to b, not at all when b < a."""
        return f"LATERAL VIEW explode(CASE WHEN ({b}) >= ({a}) THEN sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END) u_{i} AS {i}"

    def words(self, text, pos, word):
        return f"LATERAL VIEW posexplode(filter(split({text}, '[ \\n\\t\\r]+'), x -> x <> '')) u_{word} AS {pos}, {word}"

    def parts(self, text, sep, part):
        return f"LATERAL VIEW explode(filter(split({text}, '[{sep}]'), x -> x <> '')) u_{part} AS {part}"

    def text_of(self, x, order, sep=" "):
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS x))), y -> y.x), '{sep}')"

    def micros(self, ts):
        return f"unix_micros(CAST({ts} AS TIMESTAMP))"

    def prop(self, props, key):
        return f"CAST(get_json_object({props}, '$.{key}') AS BIGINT)"

    def vector(self, v, pos, x):
        return f"LATERAL VIEW posexplode({v}) u_{x} AS {pos}, {x}"

    def first_word(self, x, sep):
        return f"split({x}, '[{sep}]')[0]"

    def matches(self, x, pattern):
        return f"({x} RLIKE '{pattern}')"

    def month(self, ts):
        return f"CAST(year({ts}) * 12 + month({ts}) AS BIGINT)"

    def hash_unit(self, *cols):
        return "(CAST(conv(substr(md5(concat_ws('|', " + ", ".join(f"CAST({c} AS STRING)" for c in cols) + ")), 1, 8), 16, 10) AS DOUBLE) + 0.5e0) / 4294967296e0"


class Duck(Dialect):
    name = "duck"

    def held(self, x, order):
        return f"list({x} ORDER BY {order})"

    def array_at(self, array, pos, x):
        return f", LATERAL (SELECT unnest(range(len({array}))) AS {pos}, unnest({array}) AS {x}) AS u_{x}"

    def rint(self, x):
        return f"round_even(({x})::DOUBLE, 0)::DOUBLE"

    def div(self, a, b):
        return f"(({a}) // ({b}))"

    def series(self, a, b, i):
        return f", LATERAL (SELECT unnest(range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1)) AS {i}) AS u_{i}"

    def words(self, text, pos, word):
        return f", LATERAL (SELECT unnest(range(len(ws))) AS {pos}, unnest(ws) AS {word} FROM (SELECT list_filter(string_split_regex({text}, '[ \n\t\r]+'), lambda x: x <> '') AS ws)) AS u_{word}"

    def parts(self, text, sep, part):
        return f", LATERAL (SELECT unnest(list_filter(string_split({text}, '{sep}'), lambda x: x <> '')) AS {part}) AS u_{part}"

    def text_of(self, x, order, sep=" "):
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def micros(self, ts):
        return f"epoch_us({ts})"

    def prop(self, props, key):
        return f"CAST(json_extract({props}, '$.{key}') AS BIGINT)"

    def vector(self, v, pos, x):
        return f", LATERAL (SELECT unnest(range(len({v}))) AS {pos}, unnest({v}) AS {x}) AS u_{x}"

    def first_word(self, x, sep):
        return f"string_split({x}, '{sep}')[1]"

    def matches(self, x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def month(self, ts):
        return f"CAST(year({ts}) * 12 + month({ts}) AS BIGINT)"

    def hash_unit(self, *cols):
        return "(CAST(('0x' || substr(md5(concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")), 1, 8)) AS BIGINT) + 0.5e0) / 4294967296e0"
