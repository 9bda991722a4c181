"""URL resolution and safety checks as column expressions (no Python in the row path).

Follows the browser rules for http(s): relative resolution, dot segments, lower-case host,
default ports, number-form IPv4 hosts, percent-encoding of unsafe characters, percent-encoded host
names and those outside ASCII (``hosts``).

The rules are written as Spark SQL text with ``x -> ...`` lambdas as local names: one parse instead
of thousands of Column calls, which keeps planning short when a query resolves many fields.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterspark.functions.hosts import ascii_host
from rosterspark.functions.text import col, filled, trim

Sql = str
_names = count()


def _lambda(body: Callable[[Sql], Sql]) -> Sql:
    name = f"u{next(_names)}_"
    return f"{name} -> {body(name)}"


def _let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    return f"transform(array({value}), {_lambda(body)})[0]"


def _raw(pattern: str) -> Sql:
    """A pattern as raw SQL text; quotes are written as code points."""
    return "r'" + pattern.replace("'", r"\x27").replace('"', r"\x22") + "'"


def _take(text: Sql, pattern: str) -> Sql:
    return f"regexp_extract({text}, {_raw(pattern)}, 1)"


def _like(text: Sql, pattern: str) -> Sql:
    return f"({text} rlike {_raw(pattern)})"


def _swap(text: Sql, pattern: str, by: str = "") -> Sql:
    return f"regexp_replace({text}, {_raw(pattern)}, '{by}')"


def _apply(value: Column, body: Sql) -> Column:
    """Value of the SQL lambda ``body`` for a column."""
    return F.call_function("transform", F.array(value), F.expr(body))[0]


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PATH_UNSAFE = r'[^\x21-\x7e]|["<>`{}^]'
_QUERY_UNSAFE = r"""[^\x21-\x7e]|["<>']"""
_FRAGMENT_UNSAFE = r'[^\x21-\x7e]|["<>`]'


def _percent(text: Sql, unsafe: str) -> Sql:
    def encode(ch: Sql) -> Sql:
        code = _swap(f"hex(encode({ch}, 'UTF-8'))", "(..)", "%$1")
        return f"if({_like(ch, unsafe)}, {code}, {ch})"

    return _let(text, lambda x: f"if({_like(x, unsafe)}, array_join(transform(split({x}, ''), {_lambda(encode)}), ''), {x})")


def _drop_dots(path: Sql) -> Sql:
    """Resolve '.' and '..' segments of an absolute path."""

    def is_dot(s):
        return f"(lower({s}) in ('.', '%2e'))"

    def is_up(s):
        return f"(lower({s}) in ('..', '.%2e', '%2e.', '%2e%2e'))"

    def fold(segments):
        kept = (
            f"aggregate({segments}, cast(array() as array<string>), (k_, s_) -> case when {is_up('s_')} "
            f"then slice(k_, 1, greatest(size(k_) - 1, 0)) when {is_dot('s_')} then k_ else concat(k_, array(s_)) end)"
        )
        last = f"element_at({segments}, -1)"
        closing = f"if({is_up(last)} or {is_dot(last)}, array(''), cast(array() as array<string>))"
        return f"concat('/', array_join(concat({kept}, {closing}), '/'))"

    dotted = _like(path, r"(?i)/(\.|%2e){1,2}(/|\z)")
    return f"if({dotted}, {_let(f"split(substring({path}, 2), '/')", fold)}, {path})"


def _dotted(value: Sql) -> Sql:
    octets = ", ".join(f"cast(shiftright({value}, {s}) & 255 as string)" for s in (24, 16, 8, 0))
    return f"concat_ws('.', {octets})"


def _canonical_host(host: Sql) -> Sql:
    """Lower-case ASCII host; a number-form IPv4 host becomes dotted decimal; null if unusable."""

    def number(p):
        return (
            f"try_cast(case when {_like(p, r'^0x[0-9a-f]{0,12}\z')} then conv(concat('0', substring({p}, 3)), 16, 10) "
            f"when {_like(p, r'^0[0-7]{1,14}\z')} then conv({p}, 8, 10) "
            f"when {_like(p, r'^(0|[1-9][0-9]{0,11})\z')} then {p} end as bigint)"
        )

    def build(nums):
        lead = f"slice({nums}, 1, size({nums}) - 1)"
        last = f"element_at({nums}, -1)"
        high = f"aggregate(transform({lead}, (v_, i_) -> v_ * cast(pow(256, 3 - i_) as bigint)), 0L, (a_, v_) -> a_ + v_)"
        ok = (
            f"forall({nums}, v_ -> v_ is not null) and forall({lead}, v_ -> v_ <= 255) "
            f"and {last} < cast(pow(256, 5 - size({nums})) as bigint)"
        )
        return f"if({ok}, {_let(f'{high} + {last}', _dotted)}, null)"

    def judge(h):
        labels = f"split({_swap(h, r'\.\z')}, {_raw(r'\.')})"
        numeric = _let(f"transform({labels}, {_lambda(number)})", build)
        return (
            f"case when {_like(h, r'^\[[0-9a-f:.]+\]\z')} then {h} "
            f"when {h} = '' or {_like(h, r'[^\x21-\x7e]|[#%/:<>?@\[\\\]^|]')} then null "
            f"when not {_like(h, r'(^|\.)(0x[0-9a-f]*|[0-9]+)\.?\z')} then {h} "
            f"when size({labels}) > 4 then null else {numeric} end"
        )

    return _let(ascii_host(host), judge)


_PARTS = "struct<href:string,origin:string,protocol:string,host:string,userinfo:string>"


def _struct(**fields: Sql) -> Sql:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _web_url(scheme: Sql, rest: Sql) -> Sql:
    """Parts of ``scheme://rest`` where ``rest`` starts at the authority."""

    def read(s):
        path = f"translate({_take(s, r'(?s)^[^/\\?#]*([/\\][^?#]*)')}, {_raw(chr(92))}, '/')"
        return _struct(
            authority=_take(s, r"(?s)^([^/\\?#]*)"), path=f"coalesce(nullif({path}, ''), '/')",
            query=_take(s, r"(?s)^[^?#]*(\?[^#]*)"), fragment=_take(s, r"(?s)^[^#]*(#.*)\z"),
        )

    def split_authority(p):
        host_port = _take(f"{p}.authority", r"(?s)([^@]*)\z")
        return _struct(
            userinfo=_take(f"{p}.authority", r"(?s)^(.*)@"), host=_canonical_host(_swap(host_port, r":[0-9]*\z")),
            port=_take(host_port, r":0*([0-9]*)\z"), path=f"{p}.path", query=f"{p}.query", fragment=f"{p}.fragment",
        )

    def with_port(p):
        default = f"if({scheme} = 'http', '80', '443')"
        # The port is digits only; five of them always fit, so the cast is safe.
        in_range = f"if(length({p}.port) > 5, false, if({p}.port = '', true, cast({p}.port as int) <= 65535))"
        usable = f"{p}.host is not null and {in_range}"
        shown = f"if({p}.port = '' or {p}.port = {default}, '', concat(':', {p}.port))"
        return f"if({usable}, {_let(shown, lambda port: write(p, port))}, null)"

    def write(p, port):
        login = f"if({p}.userinfo = '', '', concat({p}.userinfo, '@'))"
        href = (
            f"concat({scheme}, '://', {login}, {p}.host, {port}, {_percent(_drop_dots(f'{p}.path'), _PATH_UNSAFE)}, "
            f"{_percent(f'{p}.query', _QUERY_UNSAFE)}, {_percent(f'{p}.fragment', _FRAGMENT_UNSAFE)})"
        )
        return _struct(
            href=href, origin=f"concat({scheme}, '://', {p}.host, {port})", protocol=scheme,
            host=_swap(f"{p}.host", r"^\[|\]\z"), userinfo=_swap(f"{p}.userinfo", r"^:\z"),
        )

    return _let(_let(rest, read), lambda p: _let(split_authority(p), with_port))


_CONTROLS = "'" + "".join(f"\\u{i:04x}" for i in range(0x21)) + "'"


def _clean(c: Sql) -> Sql:
    return f"translate(btrim({c}, {_CONTROLS}), '\\t\\n\\r', '')"


# Already canonical references, the common case: read off instead of taken apart. Dots after a slash, percent
# signs in the path, logins, ports and number hosts go the long way.
_PLAIN_PATH = r"(?!\.)(?!.*/\.)[A-Za-z0-9_~!$&()*+,;=:@/.-]*"
_PLAIN_REST = r"(?:\?[A-Za-z0-9_~!$&()*+,;=:@/.?%-]*)?(?:#[A-Za-z0-9_~!$&()*+,;=:@/.?%-]*)?\z"
_PLAIN_ROOTED = rf"^/(?!/){_PLAIN_PATH}{_PLAIN_REST}"
_PLAIN_WEB = rf"^https?://[a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)+/{_PLAIN_PATH}{_PLAIN_REST}"


def _read_off(ref: Sql) -> Sql:
    return _struct(
        href=ref, origin=_take(ref, r"^(https?://[^/]*)"), protocol=_take(ref, r"^(https?)"),
        host=_take(ref, r"^https?://([^/]*)"), userinfo="''",
    )


def _absolute(r: Sql) -> Sql:
    def by_scheme(scheme):
        rest = _swap(r, _SCHEME)
        opaque = _struct(href=f"concat({scheme}, ':', {rest})", origin="'null'", protocol=scheme, host="''", userinfo="''")
        web = _web_url(scheme, _swap(rest, r"^[/\\]+"))
        return f"case when {scheme} in ('http', 'https') then {web} when {scheme} <> '' then {opaque} else cast(null as {_PARTS}) end"

    return f"case when {_like(r, _PLAIN_WEB)} then {_read_off(r)} else {_let(f'lower({_take(r, _SCHEME)})', by_scheme)} end"


def _joined(r: Sql, b: Sql) -> Sql:
    site = _take(b, r"(?i)^(https?://[^/?#]*)")
    path = _take(b, r"(?i)^https?://[^/?#]*([^?#]*)")
    folder = f"coalesce(nullif({_take(b, r'(?i)^https?://[^/?#]*([^?#]*/)')}, ''), '/')"
    return (
        f"case when {_like(r, _SCHEME)} then {r} "
        f"when {b} is null or {site} = '' then null "
        f"when {_like(r, r'^[/\\]{2}')} then concat({_take(b, r'(?i)^(https?:)')}, {r}) "
        f"when {_like(r, r'^[/\\]')} then concat({site}, '/', substring({r}, 2)) "
        f"when startswith({r}, '?') then concat({site}, {path}, {r}) "
        f"when {r} = '' or startswith({r}, '#') then concat({_take(b, r'^([^#]*)')}, {r}) "
        f"else concat({site}, {folder}, {r}) end"
    )


def _resolved(pair: Sql) -> Sql:
    return _let(
        _struct(r=_clean(f"{pair}.r"), b=_clean(f"{pair}.b")),
        lambda p: _let(_joined(f"{p}.r", f"{p}.b"), _absolute),
    )


_ABSOLUTE = _lambda(lambda v: _let(_clean(v), _absolute))
_RESOLVED = _lambda(_resolved)


def url_parts(ref: Column | str, base: Column | str | None = None) -> Column:
    """``struct(href, origin, protocol, host, userinfo)`` of ``ref`` resolved on ``base``, or null.

    ``base`` must be an absolute http(s) URL. Other schemes (mailto:, tel:) keep their text and
    have the origin 'null'.
    """
    if base is None:
        return _apply(col(ref), _ABSOLUTE)
    return _apply(F.struct(col(ref).alias("r"), col(base).alias("b")), _RESOLVED)


def _on_page(v: Sql) -> Sql:
    ref, page = f"{v}.ref", f"{v}.page"
    rooted = _struct(
        href=f"concat({page}.origin, {ref})", origin=f"{page}.origin", protocol=f"{page}.protocol", host=f"{page}.host", userinfo="''"
    )
    other = _let(_struct(r=ref, b=f"{page}.href"), _resolved)
    return (
        f"case when {page}.origin is not null and {page}.userinfo = '' and {_like(ref, _PLAIN_ROOTED)} then {rooted} "
        f"when {_like(ref, _PLAIN_WEB)} then {_read_off(ref)} else {other} end"
    )


_ON_PAGE = _lambda(_on_page)


def resolve_on(ref: Column, page: Column) -> Column:
    """``url_parts`` of ``ref`` on ``page``, the parts of a page address computed before.

    References that are canonical already take a short way with the same result.
    """
    return _apply(F.struct(ref.alias("ref"), page.alias("page")), _ON_PAGE)


_HREF_ON_PAGE = _lambda(lambda v: f"if({v}.ref is null or {v}.ref = '', null, ({_on_page(v)}).href)")


def absolutize_many(refs: list[Column], page: Column) -> Column:
    """Array of the absolute forms of ``refs`` on one page (``url_parts`` of its address)."""
    pairs = F.array(*[F.struct(r.alias("ref"), page.alias("page")) for r in refs])
    return F.call_function("transform", pairs, F.expr(_HREF_ON_PAGE))


def absolutize(ref: Column | str, base: Column | str) -> Column:
    """Absolute form of ``ref`` on a page; missing, empty or unusable gives null."""
    return F.when(filled(ref).isNotNull(), url_parts(ref, base)["href"])


# Lower-case host without login, port or number form: host and origin can be read off.
_PLAIN_HOST = r"^https?://[a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)+(?:[/?#]|\z)"
_ORIGIN = _lambda(lambda v: f"if({_like(v, _PLAIN_HOST)}, {_take(v, r'^(https?://[^/?#]*)')}, ({_let(_clean(v), _absolute)}).origin)")
_HOST = _lambda(lambda v: f"if({_like(v, _PLAIN_HOST)}, {_take(v, r'^https?://([^/?#]*)')}, ({_let(_clean(v), _absolute)}).host)")


def url_origin(c: Column | str) -> Column:
    return _apply(col(c), _ORIGIN)


def url_host(c: Column | str) -> Column:
    return _apply(col(c), _HOST)


# --- submitted-URL safety -------------------------------------------------------------------

# Reasons a submitted URL is refused.
REASON_EMPTY = "Enter a URL."
REASON_LONG = "That URL is too long."
REASON_INVALID = "That doesn't look like a valid URL."
REASON_SCHEME = "Only http:// and https:// URLs are allowed."
REASON_LOGIN = "URLs with a username/password aren't allowed."
REASON_HOST = "That host isn't reachable from here."

MAX_SUBMITTED_URL = 2000


def _private_ipv4(host: Sql) -> Sql:
    """Loopback, private, link-local, test and reserved IPv4 ranges of a dotted host."""

    def check(o):
        a, b = f"{o}[0]", f"{o}[1]"
        return (
            f"{a} in (0, 10, 127) or {a} >= 224 or ({a} = 100 and {b} between 64 and 127) or ({a} = 169 and {b} = 254) "
            f"or ({a} = 172 and {b} between 16 and 31) or ({a} = 192 and {b} in (0, 168)) "
            f"or ({a} = 198 and {b} in (18, 19, 51)) or ({a} = 203 and {b} = 0)"
        )

    octets = f"transform(split({host}, {_raw(r'\.')}), p_ -> try_cast(p_ as int))"
    dotted = _like(host, r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    inside = _let(octets, lambda o: f"(forall({o}, v_ -> v_ <= 255) and ({check(o)}))")
    return f"coalesce(if({dotted}, {inside}, false), false)"


def _private_ipv6(host: Sql) -> Sql:
    """The same for IPv6 text: loopback, link-local, unique-local and IPv4-mapped hosts."""

    def widen(h):
        tail = _take(h, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\z")

        def pairs(o):
            two = [f"lower(hex({o}[{i}] * 256 + {o}[{i + 1}]))" for i in (0, 2)]
            return f"concat({_swap(h, r'[0-9.]+\z')}, {two[0]}, ':', {two[1]})"

        octets = f"transform(split({tail}, {_raw(r'\.')}), p_ -> try_cast(p_ as int))"
        return f"if({tail} = '', {h}, {_let(octets, pairs)})"

    def groups(h):
        def items(text):
            return f"filter(split({text}, ':'), g_ -> g_ <> '')"

        def fill(s):
            gap = f"(8 - size({s}.l) - size({s}.r))"
            texts = (
                f"case when {gap} > 0 then concat({s}.l, array_repeat('0', {gap}), {s}.r) "
                f"when {gap} = 0 then concat({s}.l, {s}.r) end"
            )
            return f"transform({texts}, g_ -> try_cast(conv(g_, 16, 10) as int))"

        def sides(s):
            return _let(_struct(l=items(f"{s}[0]"), r=items(f"coalesce(try_element_at({s}, 2), '')")), fill)

        return _let(f"split({h}, '::')", sides)

    def check(g):
        def zero(n):
            return f"forall(slice({g}, 1, {n}), v_ -> v_ = 0)"

        mapped = _let(_dotted(f"(cast({g}[6] as bigint) * 65536 + {g}[7])"), _private_ipv4)
        return (
            f"(({zero(7)} and {g}[7] in (0, 1)) or ({g}[0] <> 0 and {_like(f'lower(hex({g}[0]))', '^(fe[89ab]|f[cd])')}) "
            f"or ({zero(5)} and {g}[5] = 65535 and {mapped}))"
        )

    parsed = _let(_let(f"lower({host})", widen), groups)
    return f"coalesce(if(contains({host}, ':'), {_let(parsed, check)}, false), false)"


def check_submission_url(c: Column | str, longest: int | None = MAX_SUBMITTED_URL) -> Column:
    """``struct(ok, reason, href)``: the first rule that a submitted URL breaks, in order. ``longest`` None: of any length."""

    def said(reason: str) -> Sql:
        return "'" + reason.replace("'", "\\'") + "'"

    def rules(v):
        t, p = f"{v}.t", f"{v}.p"
        local = f"({_like(f'{p}.host', r'(^|\.)localhost\z')} or endswith({p}.host, '.local'))"
        private = _let(f"{p}.host", lambda h: f"({_private_ipv4(h)} or {_private_ipv6(h)})")
        too_long = "" if longest is None else f"when length({t}) > {longest} then {said(REASON_LONG)} "
        reason = (
            f"case when {t} = '' then {said(REASON_EMPTY)} {too_long}"
            f"when {p} is null then {said(REASON_INVALID)} when {p}.protocol not in ('http', 'https') then {said(REASON_SCHEME)} "
            f"when {p}.userinfo <> '' then {said(REASON_LOGIN)} when {local} or {private} then {said(REASON_HOST)} end"
        )
        return _let(reason, lambda r: _struct(ok=f"{r} is null", reason=r, href=f"if({r} is null, {p}.href, null)"))

    judged = _lambda(lambda t: _let(_struct(t=t, p=_let(_clean(t), _absolute)), rules))
    return _apply(trim(F.coalesce(col(c), F.lit(""))), judged)
