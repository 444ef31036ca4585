"""Small scalar columns: keys, addresses, tokens, settings, maps, dates, ciphers."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwell import catalog as cat

# -- keys and tokens ---------------------------------------------------------


def key_preview(key: Column) -> Column:
    return F.when(F.char_length(key) < 8, F.lit("****")).otherwise(
        F.concat(F.substring(key, 1, 12), F.lit("****"), F.right(key, F.lit(4))))


def audit_key_preview(token: Column) -> Column:
    """Preview of a service key in the audit trail; null for other tokens."""
    p = cat.SERVICE_KEY_PREFIX
    return F.when(token.startswith(p), F.when(
        F.char_length(token) >= 16,
        F.concat(F.substring(token, 1, 12), F.lit("****"), F.right(token, F.lit(4))))
        .otherwise(F.lit(p + "****")))


def mask_tail(key: Column) -> Column:
    return F.when(F.char_length(key) <= 4, F.lit("****")).otherwise(F.concat(F.lit("..."), F.right(key, F.lit(4))))


def mask_provider(last4: Column, provider: Column) -> Column:
    lead = F.when(provider == "openai", F.lit("sk-****")).when(
        provider == "anthropic", F.lit("sk-ant-****")).otherwise(F.lit("****"))
    return F.concat(lead, last4)


def key_prefix(key: Column) -> Column:
    return F.concat(F.substring_index(key, "_", 2), F.lit("_"))


def key_format_valid(key: Column, provider: Column) -> Column:
    """Provider prefix and at least twenty characters."""
    ok = F.char_length(key) >= 20
    return F.coalesce(
        F.when(provider == "openai", key.startswith("sk-") & ok)
        .when(provider == "anthropic", key.startswith("sk-ant-") & ok), F.lit(False))


def stored_key_format_valid(key: Column, provider: Column) -> Column:
    """Variant for stored keys: four providers, more than twenty characters."""
    ok = F.char_length(key) > 20
    return F.coalesce(
        F.when(provider == "openai", key.startswith("sk-") & ok)
        .when(provider == "anthropic", key.startswith("sk-ant-") & ok)
        .when(provider == "cohere", ok)
        .when(provider == "huggingface", key.startswith("hf_") & ok), F.lit(False))


def token_shape(header: Column) -> Column:
    """Class of an Authorization header."""
    parts = F.filter(F.split(header, r"\s+"), lambda x: x != "")
    token = F.try_element_at(parts, F.lit(2))
    return (F.when(header.isNull() | (header == ""), F.lit("missing"))
            .when((F.size(parts) != 2) | (F.lower(F.try_element_at(parts, F.lit(1))) != "bearer"), F.lit("malformed"))
            .when(F.char_length(token) < 10, F.lit("too_short"))
            .when(token.startswith(cat.SERVICE_KEY_PREFIX), F.lit("service_key"))
            .when(token.contains("."), F.lit("jwt_like"))
            .otherwise(F.lit("unknown_format")))


def client_ip(forwarded: Column, real_ip: Column, peer: Column) -> Column:
    """First forwarded hop, else the proxy's real-ip header, else the peer."""
    hop = F.when(forwarded != "", F.trim(F.substring_index(forwarded, ",", 1)))
    return F.coalesce(hop, F.when(real_ip != "", real_ip), peer, F.lit("unknown"))


def event_type(status: Column) -> Column:
    return F.when(status == 401, F.lit("auth_failure")).when(
        status == 429, F.lit("rate_limit_hit")).otherwise(F.lit("api_request"))


def audited(endpoint: Column) -> Column:
    """Requests that leave an audit row (health, docs and metrics do not)."""
    return F.coalesce(~endpoint.isin(*cat.AUDIT_SKIP_PATHS), F.lit(True))


def within_bytes(text: Column, limit: int = cat.MAX_BODY_BYTES) -> Column:
    return F.octet_length(text) <= limit


def within_chars(text: Column, limit: int = cat.DEMO_MAX_CHARS) -> Column:
    return F.char_length(text) <= limit


# -- dates -------------------------------------------------------------------


def inclusive_days(ts: Column, first, last) -> Column:
    """Whole days from `first` to `last`, both included; None leaves a side open."""
    cond = F.lit(True)
    if first is not None:
        cond = cond & (ts >= F.to_timestamp_ntz(F.lit(str(first))))
    if last is not None:
        cond = cond & (ts < F.to_timestamp_ntz(F.lit(str(last))) + F.expr("interval 1 day"))
    return cond


def ntz(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def expires_at(created: Column, days: Column) -> Column:
    return created + F.make_dt_interval(days=days.cast("int"))


def is_expired(expires: Column, now: Column) -> Column:
    return F.coalesce(expires < now, F.lit(False))


# -- maps and settings ---------------------------------------------------------


def overlay(base: Column, top: Column) -> Column:
    """Map of `base` with the entries of `top` put over it; nulls in top are ignored."""
    new = F.map_filter(F.coalesce(top, F.map_filter(base, lambda k, v: F.lit(False))), lambda k, v: v.isNotNull())
    old = F.map_filter(base, lambda k, v: ~F.map_contains_key(new, k))
    return F.when(base.isNull(), new).otherwise(F.map_concat(old, new))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def invalid_permissions(requested: Column) -> Column:
    return F.array_except(requested, F.array(*[F.lit(p) for p in cat.PERMISSIONS]))


def effective_redact(request: Column, pack: Column, default: Column) -> Column:
    return F.coalesce(request, pack, default, F.lit(False))


def effective_filters(request: Column, pack: Column, mode: str = "null") -> Column:
    """Filters in force.

    mode="null": an unset request is null.  mode="equality": a request equal to
    the default set counts as unset when a pack is attached.
    """
    default = F.array(*[F.lit(f) for f in cat.DEFAULT_FILTERS])
    if mode == "equality":
        given = F.coalesce(request, default)
        return F.when(pack.isNotNull() & same_set(given, default), pack).otherwise(given)
    return F.coalesce(request, pack, default)


def effective_threshold(request: Column, pack: Column, default: Column, mode: str = "null") -> Column:
    system = F.lit(cat.DEFAULT_TOXICITY)
    if mode == "equality":
        given = F.coalesce(request, system)
        return F.when(pack.isNotNull() & (given == system), pack).otherwise(given)
    return F.coalesce(request, pack, default, system)


def effective_analyzer(request: Column, pack: Column, default: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in (request, pack, default)])


# -- column protection ---------------------------------------------------------


def derive_key(secret: str, salt: bytes, iterations: int = 100_000) -> bytes:
    """256-bit key by PBKDF2-SHA256, derived once on the driver."""
    if not secret:
        raise ValueError("an encryption secret is required")
    return hashlib.pbkdf2_hmac("sha256", secret.encode(), salt, iterations, dklen=32)


def encrypt(text: Column, key: Column) -> Column:
    """base64(nonce + ciphertext + tag) by AES-256-GCM with a fresh nonce, in one line."""
    return F.translate(F.base64(F.aes_encrypt(text, key, F.lit("GCM"))), "\r\n", "")


def decrypt(stored: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(stored), key, F.lit("GCM")).cast("string")


def last_four(text: Column) -> Column:
    return F.right(text, F.lit(4))
