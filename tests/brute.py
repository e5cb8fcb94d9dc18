"""Brute-force scoring by definition: every question is answered by scanning all earlier messages.

Only for tests, on a few dozen messages; nothing is kept incrementally.
"""

from __future__ import annotations

import math
import statistics
from functools import cache

DAY = 86400
FREEMAIL = {"gmail.com", "yahoo.com"}
FOLD = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s"})


def domain(address):
    return address.split("@")[-1]


@cache
def osa(a, b):
    if not a or not b:
        return len(a) + len(b)
    options = [osa(a[1:], b) + 1, osa(a, b[1:]) + 1, osa(a[1:], b[1:]) + (a[0] != b[0])]
    if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
        options.append(osa(a[2:], b[2:]) + 1)
    return min(options)


class Mailbox:
    """Messages are dicts; ``order`` sorts them into the sequence in which they are judged."""

    def __init__(self, messages, arrival=False):
        self.arrival = arrival
        self.seq = sorted(messages, key=lambda m: m["msg_id"] if arrival else (m["sent_at"], m["msg_id"]))
        self.credits = self._credits()

    def _visible(self, i, m):
        """Whether message m is stored when event i happens (in a replay all are)."""
        return not self.arrival or m["msg_id"] < self.seq[i]["msg_id"]

    def _credits(self):
        given = {}
        for i, out in enumerate(self.seq):
            if out["direction"] != "out":
                continue
            writers = {
                m["from_email_norm"]
                for m in self.seq
                if m["direction"] == "in" and m["thread_id"] == out["thread_id"]
                and m["sent_at"] < out["sent_at"] and self._visible(i, m)
            }
            for w in writers:
                given.setdefault((out["thread_id"], w), (i, "replied"))
            for r in out["recipients"]:
                if r not in writers:
                    given.setdefault((out["thread_id"], r), (i, "initiated"))
        return given

    def before(self, i, sender):
        return [m for m in self.seq[:i] if m["direction"] == "in" and m["from_email_norm"] == sender]

    def tier(self, i, sender):
        if any(s == sender and at < i for (_, s), (at, _) in self.credits.items()):
            return 3
        times = [m["sent_at"] for m in self.before(i, sender)]
        dated = [t for t in times if t]
        if len(times) >= 2 and dated and max(times) - min(dated) >= 7 * DAY:
            return 2
        rd = domain(sender)
        if rd not in FREEMAIL and any(
            domain(s) == rd and kind == "replied" and at < i
            for (_, s), (at, kind) in self.credits.items()
        ):
            return 1
        return 0

    def everyone(self):
        people = {m["from_email_norm"] for m in self.seq if m["direction"] == "in"}
        return people | {r for m in self.seq if m["direction"] == "out" for r in m["recipients"]}

    def lookalike(self, i, rd):
        trusted = {domain(s) for s in self.everyone() if self.tier(i, s) >= 2}
        if rd in trusted or len(rd) < 6:
            return 0
        best = 0
        for t in trusted - FREEMAIL - {rd}:
            if len(t) >= 6:
                a, b = rd.translate(FOLD), t.translate(FOLD)
                best = max(best, 1.0 if a == b else {1: 0.9, 2: 0.6}.get(osa(a, b), 0))
        return best

    def collision(self, i, name, sender):
        name = (name or "").lower()
        skeleton = name.translate(FOLD)
        return len(name) >= 4 and any(
            m["from_email_norm"] != sender
            and (m["from_display_name"] or "").lower().translate(FOLD) == skeleton
            and self.tier(i, m["from_email_norm"]) == 3
            for m in self.seq[:i]
            if m["direction"] == "in"
        )

    def features(self, i):
        m = self.seq[i]
        sender, rd = m["from_email_norm"], domain(m["from_email_norm"])
        old, tier = self.before(i, sender), self.tier(i, sender)
        n, conf = len(old), len(old) / (len(old) + 10)
        links, raw = m["link_domains"], {}
        raw["lookalike_domain"] = self.lookalike(i, rd)
        raw["display_name_collision"] = self.collision(i, m["from_display_name"], sender)
        if m["auth_dmarc"] == "fail":
            raw["auth_fail"] = 1
        elif m["auth_dkim"] == "fail" and m["auth_spf"] in ("fail", "softfail"):
            raw["auth_fail"] = 0.8
        elif m["auth_spf"] == "softfail":
            raw["auth_fail"] = 0.4
        reply = m["reply_to_email_norm"]
        diverges = reply is not None and domain(reply) != rd
        if tier >= 2 and diverges and all(o["reply_to_email_norm"] != reply for o in old):
            raw["reply_to_divergence"] = 1
        if tier >= 2 and n >= 8:
            kinds = {(a["extension"], a["mime_type"]) for a in m["attachments"]}
            seen = {(a["extension"], a["mime_type"]) for o in old for a in o["attachments"]}
            if kinds and not seen:
                raw["first_attachment_ever"] = conf
            elif kinds - seen:
                raw["attachment_type_novelty"] = conf
            if links and m["links_extracted"]:
                known = {d for o in old for d in o["link_domains"]}
                raw["link_domain_novelty"] = len(set(links) - known) / len(links) * conf
            hours = [o["sent_hour_local"] for o in old if o["sent_hour_local"] is not None]
            if m["sent_hour_local"] is not None and len(hours) >= 8:
                p = (hours.count(m["sent_hour_local"]) + 0.5) / (len(hours) + 12)
                raw["send_hour_anomaly"] = 1 - 24 * p
            totals = [sum(o["link_domains"].values()) for o in old]
            if links:
                z = (sum(links.values()) - statistics.fmean(totals)) / max(statistics.stdev(totals), 1)
                raw["link_density_anomaly"] = (z - 2) / 4
            sizes = [math.log(max(o["size_bytes"], 1)) for o in old]
            z = abs(math.log(max(m["size_bytes"], 1)) - statistics.fmean(sizes)) / max(
                statistics.stdev(sizes), 0.35
            )
            raw["size_anomaly"] = (z - 2.5) / 4
        elif tier <= 1 and n < 8:
            scale = 1 if n == 0 else 0.5
            raw["cold_attachment"] = scale * bool(m["attachments"])
            raw["cold_links"] = scale * bool(links)
            raw["cold_replyto"] = scale * diverges
        raw = {k: round(min(v, 1.0), 4) for k, v in raw.items() if v > 0}
        if tier >= 2 and n >= 8 and raw:
            gap = m["sent_at"] - max(o["sent_at"] for o in old)
            times = sorted(
                o["sent_at"] for j, o in enumerate(self.seq)
                if o["direction"] == "in" and o["from_email_norm"] == sender
                and o["sent_at"] < m["sent_at"] and self._visible(i, o)
            )
            gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
            if gap >= 90 * DAY and len(times) >= 3:
                median = statistics.median(gaps)
                if median and gap > 6 * median:
                    raw["dormant_resurrection"] = 1.0
        return tier, n, raw

    def judged(self):
        """msg_id -> (tier, baseline, raw values)."""
        return {
            m["msg_id"]: self.features(i) for i, m in enumerate(self.seq) if m["direction"] == "in"
        }

    def final_tiers(self):
        """Tier of each sender stored after its own last event."""
        out = {}
        for s in self.everyone():
            own = [i for i, m in enumerate(self.seq) if m["direction"] == "in" and m["from_email_norm"] == s]
            credited = [at for (_, who), (at, _) in self.credits.items() if who == s]
            if own or credited:
                last = max(own + credited)
                out[s] = self.tier(last + 1, s) if last in credited or not own else self._after(last, s)
        return out

    def _after(self, i, s):
        """Tier right after incoming event i: own history includes it."""
        return self.tier(i + 1, s)
