"""HTTP requests with authentication, retries, rate limits and redirects."""

from __future__ import annotations

import email.utils
import json
import random
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

REDIRECTS = (301, 302, 307, 308)
TIMEOUT_SECONDS = 60.0


@dataclass
class Request:
    url: str
    method: str = "GET"
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes | None = None


@dataclass
class Response:
    status: int
    headers: dict[str, str]
    body: bytes
    url: str = ""

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), None)

    def redirect(self) -> str | None:
        """The absolute target of a redirect."""
        location = self.header("Location") if self.status in REDIRECTS else None
        return urllib.parse.urljoin(self.url, location) if location else None


Executor = Callable[[Request], Response]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_args, **_kwargs):
        return None


def urllib_executor(timeout: float = TIMEOUT_SECONDS) -> Executor:
    """Sends a request as it is; redirects are given back, not followed."""
    opener = urllib.request.build_opener(_NoRedirect)

    def run(request: Request) -> Response:
        if request.method not in ("GET", "POST"):
            raise ValueError(f"unsupported method {request.method}")
        sent = urllib.request.Request(request.url, data=request.body, headers=request.headers, method=request.method)
        try:
            with opener.open(sent, timeout=timeout) as got:
                return Response(got.status, dict(got.headers), got.read(), request.url)
        except urllib.error.HTTPError as e:
            return Response(e.code, dict(e.headers), e.read(), request.url)

    return run


def with_api_key(execute: Executor, key: str, header: str = "X-API-KEY") -> Executor:
    return lambda r: execute(Request(r.url, r.method, {**r.headers, header: key}, r.body))


def with_client_credentials(execute: Executor, endpoint: str, client_id: str, secret: str, scope: str | None = None, clock: Callable[[], float] = time.time) -> Executor:
    """OAuth 2 client credentials; a token is kept until 30 s before it expires."""
    held: dict = {"until": 0.0, "token": ""}
    lock = threading.Lock()

    def token() -> str:
        with lock:
            if clock() >= held["until"]:
                fields = {"grant_type": "client_credentials", "client_id": client_id, "client_secret": secret} | ({"scope": scope} if scope else {})
                got = execute(Request(endpoint, "POST", {"Content-Type": "application/x-www-form-urlencoded"}, urllib.parse.urlencode(fields).encode()))
                if got.status != 200:
                    raise OSError(f"no token: status {got.status}")
                answer = json.loads(got.body)
                held.update(token=answer["access_token"], until=clock() + float(answer.get("expires_in", 0)) - 30)
            return held["token"]

    return lambda r: execute(Request(r.url, r.method, {**r.headers, "Authorization": f"Bearer {token()}"}, r.body))


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds to wait by a Retry-After header: seconds or a date."""
    if value is None:
        return None
    if value.strip().isdigit():
        return float(value)
    try:
        return max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


def with_retries(execute: Executor, attempts: int = 5, statuses: tuple[int, ...] = (), first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> Executor:
    """Try again after no answer, 429, 5xx or a listed status; wait as told, else a random exponential time."""

    def run(request: Request) -> Response:
        for attempt in range(1, attempts + 1):
            try:
                got, failure = execute(request), None
            except OSError as e:
                got, failure = None, e
            if got is not None and not (got.status >= 500 or got.status == 429 or got.status in statuses):
                return got
            if attempt == attempts:
                if got is None:
                    raise failure
                return got
            told = retry_after(got.header("Retry-After"), clock()) if got is not None else None
            sleep(told if told is not None else first_wait * 1.5 ** (attempt - 1) * random.uniform(0.5, 1.5))
        raise AssertionError

    return run


def with_rate_limit(execute: Executor, limit: int = 500, period: float = 60.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Executor:
    """At most ``limit`` requests in any period of one process."""
    state = {"start": clock(), "n": 0}
    lock = threading.Lock()

    def run(request: Request) -> Response:
        with lock:
            if clock() - state["start"] >= period:
                state.update(start=clock(), n=0)
            if state["n"] >= limit:
                sleep(max(0.0, period - (clock() - state["start"])))
                state.update(start=clock(), n=0)
            state["n"] += 1
        return execute(request)

    return run


def limited(options: Mapping[str, str]) -> bool:
    """Whether requests have a rate limit. It holds in one process, so such requests are left to one task."""
    return options.get("rate-limit.enabled", "false").lower() == "true"


def follow_redirects(execute: Executor, request: Request) -> Response:
    """The first answer that isn't a redirect; a loop raises."""
    seen = {request.url}
    while True:
        got = execute(request)
        if (target := got.redirect()) is None:
            return got
        if target in seen:
            raise OSError(f"redirects loop at {target}")
        seen.add(target)
        request = Request(target, request.method, request.headers, request.body)


def connector_executor(execute: Executor, public_url: str, connector_url: str, token: Callable[[], str], header: str = "Authorization") -> Executor:
    """Requests through a data connector: URLs are rewritten, and a 403 fetches a new token and tries once more."""
    held = {"token": ""}

    def run(request: Request) -> Response:
        url = request.url.replace(public_url, connector_url, 1) if public_url else request.url
        for attempt in range(2):
            if not held["token"]:
                held["token"] = token()
            got = execute(Request(url, request.method, {**request.headers, header: held["token"]}, request.body))
            if got.status != 403 or attempt:
                got.url = request.url
                return got
            held["token"] = ""
        raise AssertionError

    return run


def connector_token(execute: Executor, options: Mapping[str, str]) -> str:
    """Start a transfer and fetch its token: POST connector.transfer to connector.transfer-url, then GET connector.token-url."""
    if url := options.get("connector.transfer-url"):
        got = execute(Request(url, "POST", {"Content-Type": "application/json"}, options.get("connector.transfer", "{}").encode()))
        if not 200 <= got.status < 300:
            raise OSError(f"the transfer was refused: {got.status}")
    got = execute(Request(options["connector.token-url"]))
    if got.status != 200:
        raise OSError(f"no token: status {got.status}")
    answer = json.loads(got.body)
    return answer.get("authCode") or answer["token"]


def executor_from(options: Mapping[str, str]) -> Executor:
    """An executor by flat options: auth.type, connector.*, retries.*, rate-limit.*; retries(rate limit(request))."""
    run = urllib_executor(float(options.get("timeout", TIMEOUT_SECONDS)))
    kind = options.get("auth.type", "NO_AUTH").upper()
    if kind == "API_KEY":
        run = with_api_key(run, options["auth.api-key"], options.get("auth.api-key-header", "X-API-KEY"))
    elif kind == "OAUTH2_CLIENT_CREDENTIALS":
        run = with_client_credentials(run, options["auth.token-endpoint"], options["auth.client-id"], options["auth.client-secret"], options.get("auth.scope"))
    elif kind != "NO_AUTH":
        raise ValueError(f"unknown auth.type {kind}")
    if options.get("connector.token-url"):
        plain = run
        run = connector_executor(plain, options.get("connector.public-url", ""), options.get("connector.url", ""), lambda: connector_token(plain, options), options.get("connector.header", "Authorization"))
    if limited(options):
        run = with_rate_limit(run, int(options.get("rate-limit.limit", 500)), float(options.get("rate-limit.period", 60)))
    if options.get("retries.enabled", "true").lower() == "true":
        statuses = tuple(int(x) for x in options.get("retries.statuses-to-retry", "").split(",") if x.strip())
        run = with_retries(run, int(options.get("retries.max", 5)), statuses)
    return run
