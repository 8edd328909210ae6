"""One host's requests, in order: safety, robots rules, pace, redirects, retries. A transport does the sending."""

from __future__ import annotations

import ipaddress
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit, urlunsplit

# Statuses that redirect and that are worth another attempt, and limits.
REDIRECTS, MAX_REDIRECTS = frozenset((301, 302, 303, 307, 308)), 6
MAX_BACKOFF_MS, LEAST_TIMEOUT_S = 10_000, 5
ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"


@dataclass(frozen=True)
class Response:
    status: int
    body: str
    location: str = ""


#: (address, timeout in seconds, user agent) to a response; a failed connection raises OSError.
Transport = Callable[[str, int, str], Response]


@dataclass(frozen=True)
class Options:
    user_agent: str = "sievewell/1.0"
    timeout_s: int = 20
    retries: int = 2
    backoff_ms: int = 300
    delay_ms: int = 1200
    robots: str = "strict"  # strict, warn or off


def unsafe(url: str) -> str | None:
    """Why an address must not be fetched, by what it says; names are not resolved here."""
    try:
        parts = urlsplit(url.strip())
        host, _ = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return "URL host is missing or invalid."
    if not url.strip():
        return "URL cannot be blank."
    if parts.scheme.lower() not in ("http", "https"):
        return "Only public http/https URLs are allowed."
    if parts.username is not None or parts.password is not None:
        return "URLs with embedded credentials are not allowed."
    if not host:
        return "URL host is missing or invalid."
    if host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        return "Local or internal hosts are not allowed."
    try:
        address = ipaddress.ip_address(host.split("%", 1)[0])
    except ValueError:
        return None
    return None if address.is_global and not address.is_multicast else "Private or local network addresses are not allowed."


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def http_get(url: str, timeout_s: int, user_agent: str) -> Response:
    """The transport over the network: a GET without redirects, refused if the name resolves to a private address."""
    parts = urlsplit(url)
    for *_, where in socket.getaddrinfo(parts.hostname, parts.port or (443 if parts.scheme == "https" else 80), type=socket.SOCK_STREAM):
        if not ipaddress.ip_address(where[0].split("%", 1)[0]).is_global:
            raise OSError("Private or local network addresses are not allowed.")
    request = urllib.request.Request(url, headers={"User-Agent": user_agent, "Accept": ACCEPT})
    read = lambda r: Response(r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.headers.get("location") or "")
    try:
        with urllib.request.build_opener(_NoRedirects).open(request, timeout=timeout_s) as r:
            return read(r)
    except urllib.error.HTTPError as e:
        with e:
            return read(e)


def followed(source: str, location: str) -> str:
    """Where a redirect leads; a fall from https to http on one host is undone."""
    target = urljoin(source, location)
    a, b = urlsplit(source), urlsplit(target)
    if a.scheme == "https" and b.scheme == "http" and (a.hostname or "") == (b.hostname or ""):
        target = urlunsplit(b._replace(scheme="https"))
    return target


def backoff_ms(attempt: int, base_ms: int) -> int:
    """The pause before another attempt: doubled each time, ten seconds at most."""
    return min(MAX_BACKOFF_MS, max(0, base_ms) << min(attempt, 10))


def agent_key(agent: str) -> str:
    """An agent's name without version and comment; ``*`` if blank."""
    name = agent.strip().lower()
    for mark in "/ ":
        if name.find(mark) > 0:
            name = name[: name.find(mark)]
    return name or "*"


def robots_rules(body: str) -> dict[str, list[tuple[bool, str]]]:
    """(allowed, prefix) of each agent. A blank line ends a group; rules before any agent and empty prefixes do not count."""
    rules: dict[str, list[tuple[bool, str]]] = {}
    agents: list[str] = []
    for line in (body or "").splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            agents = []
            continue
        word, colon, value = line.partition(":")
        word, value = word.strip().lower(), value.strip()
        if not colon or not word:
            continue
        if word == "user-agent":
            agents += [agent_key(value)] if value else []
        elif word in ("allow", "disallow"):
            for agent in agents:
                rules.setdefault(agent, [])
                if value:
                    rules[agent].append((word == "allow", value if value.startswith("/") else f"/{value}"))
    return rules


def robots_allow(rules: dict[str, list[tuple[bool, str]]], url: str, agent: str) -> bool:
    """By the agent's own rules or else those for all: the longest prefix of either kind, allowing wins ties."""
    own = rules.get(agent_key(agent), rules.get("*"))
    if own is None:
        return True
    path = urlsplit(url).path or "/"
    longest = {kind: max((len(p) for k, p in own if k == kind and path.startswith(p)), default=-1) for kind in (True, False)}
    return longest[True] >= longest[False]


@dataclass
class Host:
    """The requests to one host: its pace, its robots rules, and counts."""

    transport: Transport
    options: Options
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = None
    requests: int = 0
    rules: dict[str, dict | None] = field(default_factory=dict)

    def _send(self, url: str) -> Response:
        if self.last is not None and (wait := self.options.delay_ms / 1000 - (self.clock() - self.last)) > 0:
            self.sleep(wait)
        self.last = self.clock()
        self.requests += 1
        return self.transport(url, max(LEAST_TIMEOUT_S, self.options.timeout_s), self.options.user_agent)

    def _got(self, url: str) -> tuple[str, Response]:
        """(final address, response) after redirects; each hop must be safe."""
        response = None
        for hop in range(MAX_REDIRECTS + 1):
            if reason := unsafe(url):
                raise OSError(reason)
            response = self._send(url)
            if hop == MAX_REDIRECTS or response.status not in REDIRECTS or not response.location:
                break
            target = followed(url, response.location)
            if target == url:
                break
            url = target
        return url, response

    def allowed(self, url: str) -> bool:
        """Robots rules are read once for each site; one that cannot be read forbids nothing."""
        site = "{0.scheme}://{0.netloc}".format(urlsplit(url))
        if site not in self.rules:
            try:
                _, response = self._got(f"{site}/robots.txt")
                self.rules[site] = robots_rules(response.body) if response.status < 400 else None
            except OSError:
                self.rules[site] = None
        return self.rules[site] is None or robots_allow(self.rules[site], url, self.options.user_agent)

    def fetch(self, url: str) -> dict:
        """status, final_url, body, error, retries of one address; status is null if no answer came."""
        error, retries = None, 0
        attempts = max(1, self.options.retries + 1)
        for attempt in range(attempts):
            last = attempt == attempts - 1
            try:
                final, response = self._got(url)
                if last or not (response.status == 429 or response.status >= 500):
                    return {"status": response.status, "final_url": final, "body": response.body, "error": error, "retries": retries}
            except OSError as e:
                error = str(e) or type(e).__name__
                if last or unsafe(url):
                    break
            retries += 1
            self.sleep(backoff_ms(attempt, self.options.backoff_ms) / 1000)
        return {"status": None, "final_url": None, "body": None, "error": error, "retries": retries}
