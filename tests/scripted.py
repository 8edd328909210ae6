"""A transport that answers from a script, for fetching without a network. It writes down each request in the folder that the user agent names."""

import os
import re
import time
import uuid

from sievewell.functions.fetching import Response

PAGE = "<html><body><a href='/jobs/1'>Platform Engineer</a></body></html>"


def requests(folder):
    """(address, when) of all requests, in order."""
    out = []
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            at, url = f.read().split(" ", 1)
        out.append((url, float(at)))
    return sorted(out, key=lambda r: r[1])


def get(url, timeout_s, user_agent):
    folder = user_agent.split("folder=", 1)[1]
    n = sum(u == url for u, _ in requests(folder))
    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
        f.write(f"{time.time()} {url}")
    if url.endswith("/robots.txt"):
        return Response(200, "User-agent: *\nDisallow: /private\nAllow: /private/jobs") if "rules." in url else Response(404, "")
    if "flaky" in url:
        return Response(503, "") if n < 2 else Response(200, PAGE)
    if "down" in url:
        raise OSError("connection refused")
    if "gone" in url:
        return Response(404, "gone")
    if m := re.search(r"hop(\d)", url):
        return Response(302, "", f"http://hops.example/hop{int(m[1]) - 1}") if m[1] != "0" else Response(200, "end")
    if "inward" in url:
        return Response(301, "", "http://127.0.0.1/admin")
    return Response(200, PAGE)
