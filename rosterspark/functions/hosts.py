"""Host names outside ASCII and percent-encoded ones, as SQL text: decoding, lower case and Bootstring (RFC 3492)."""

from __future__ import annotations

from itertools import count

Sql = str
_names = count()

# Bootstring's parameters for host names.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
# What counts as a dot, and characters that a host name drops.
DOTS = r"[\u3002\uff0e\uff61]"
DROPPED = r"[\u00ad\u200b\u2060\ufeff\ufe00-\ufe0f]"
#: Digits of a number in this notation, at most: enough for any that a name of 255 characters needs.
DIGITS = 8


def _lambda(*arity: str) -> list[str]:
    return [f"{a}{next(_names)}h" for a in arity]


def _let(value: Sql, body) -> Sql:
    (v,) = _lambda("v")
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def _digits(delta: Sql, bias: Sql) -> Sql:
    """``delta`` as a number with digits a-z and 0-9 whose weights depend on ``bias``; the last digit is below its threshold."""
    state, k = _lambda("s", "k")
    threshold = f"greatest({T_MIN}L, least({T_MAX}L, {BASE}L * {k} - {bias}))"
    digit = lambda d: f"substring('abcdefghijklmnopqrstuvwxyz0123456789', cast({d} as int) + 1, 1)"

    def step(t: Sql) -> Sql:
        last = f"named_struct('q', {state}.q, 'out', concat({state}.out, {digit(f'{state}.q')}), 'done', true)"
        over = f"({state}.q - {t})"
        more = f"named_struct('q', {over} div ({BASE}L - {t}), 'out', concat({state}.out, {digit(f'{t} + {over} % ({BASE}L - {t})')}), 'done', false)"
        return f"if({state}.done, {state}, if({state}.q < {t}, {last}, {more}))"

    return f"aggregate(sequence(1L, {DIGITS}L), named_struct('q', {delta}, 'out', '', 'done', false), ({state}, {k}) -> {_let(threshold, step)}).out"


def _adapted(delta: Sql, points: Sql, first: Sql) -> Sql:
    """The bias after ``delta``."""
    state, k = _lambda("s", "k")
    limit = (BASE - T_MIN) * T_MAX // 2
    scaled = _let(f"({delta}) div if({first}, {DAMP}L, 2L)", lambda d: f"{d} + {d} div ({points})")
    halved = f"if({state}.d > {limit}L, named_struct('d', {state}.d div {BASE - T_MIN}L, 'k', {state}.k + {BASE}L), {state})"
    ended = f"aggregate(sequence(1L, {DIGITS}L), named_struct('d', {scaled}, 'k', 0L), ({state}, {k}) -> {halved})"
    return _let(ended, lambda e: f"{e}.k + {BASE - T_MIN + 1}L * {e}.d div ({e}.d + {SKEW}L)")


def _encoded(label: Sql) -> Sql:
    """A label in Bootstring: its ASCII characters, then where the others go, smallest code first."""
    outer, code, inner, c = _lambda("o", "m", "i", "c")

    def run(points: Sql) -> Sql:
        basic = f"filter({points}, {c} -> {c} < {FIRST_CODE})"
        others = f"array_sort(array_distinct(filter({points}, {c} -> {c} >= {FIRST_CODE})))"

        def written(b: Sql) -> Sql:
            emit = (
                f"named_struct('delta', 0L, 'bias', {_adapted(f'{inner}.delta', f'{inner}.h + 1L', f'{inner}.h = {b}')}, 'h', {inner}.h + 1L, "
                f"'out', concat({inner}.out, {_digits(f'{inner}.delta', f'{inner}.bias')}))"
            )
            moved = f"named_struct('delta', {inner}.delta + 1L, 'bias', {inner}.bias, 'h', {inner}.h, 'out', {inner}.out)"
            begin = f"named_struct('delta', {outer}.delta + ({code} - {outer}.n) * ({outer}.h + 1L), 'bias', {outer}.bias, 'h', {outer}.h, 'out', {outer}.out)"
            row = f"aggregate({points}, {begin}, ({inner}, {c}) -> case when {c} < {code} then {moved} when {c} = {code} then {emit} else {inner} end)"
            after = _let(row, lambda r: f"named_struct('n', {code} + 1L, 'delta', {r}.delta + 1L, 'bias', {r}.bias, 'h', {r}.h, 'out', {r}.out)")
            start = f"named_struct('n', {FIRST_CODE}L, 'delta', 0L, 'bias', {FIRST_BIAS}L, 'h', {b}, 'out', '')"
            return f"aggregate({others}, {start}, ({outer}, {code}) -> {after}).out"

        ascii_part = f"array_join(transform({basic}, {c} -> chr({c})), '')"
        delimiter = f"if(size({basic}) > 0, '-', '')"
        return f"concat('xn--', {ascii_part}, {delimiter}, {_let(f'cast(size({basic}) as bigint)', written)})"

    (ch,) = _lambda("x")
    return _let(f"transform(split({label}, ''), {ch} -> cast(ascii({ch}) as bigint))", run)


def ascii_host(host: Sql) -> Sql:
    """A host in ASCII and lower case: percent codes decoded, full-width forms and other dots made plain, labels outside ASCII encoded.

    Null where percent codes are broken. Compatibility forms other than full-width ASCII are not mapped.
    """
    (label, ch) = _lambda("l", "w")
    plain = f"if(ascii({ch}) between 65281 and 65374, chr(ascii({ch}) - 65248), {ch})"
    narrow = lambda h: f"if({h} rlike r'[\uff01-\uff5e]', array_join(transform(split({h}, ''), {ch} -> {plain}), ''), {h})"
    decoded = f"if({host} rlike '%', if({host} rlike r'%(?![0-9A-Fa-f]{{2}})', null, try_url_decode(replace({host}, '+', '%2B'))), {host})"

    def labels(h: Sql) -> Sql:
        return rf"array_join(transform(split({h}, r'\.'), {label} -> if({label} rlike r'[^\x00-\x7f]', {_encoded(label)}, {label})), '.')"

    tidy = _let(decoded, lambda h: f"lower(regexp_replace(regexp_replace({narrow(h)}, r'{DROPPED}', ''), r'{DOTS}', '.'))")
    whole = _let(tidy, lambda h: rf"if({h} rlike r'[^\x00-\x7f]', {labels(h)}, {h})")
    return rf"if({host} rlike r'[^\x21-\x7e]|%', {whole}, lower({host}))"
