"""Random mailboxes with ties, undated rows, shared threads, self-addressed mail and silences."""

import random


DAY = 86400
DOMAINS = ("north-ford.com", "north-f0rd.com", "north-frod.com", "northford.com", "gmail.com", "other.org", "a.io")

COLUMNS = (
    "msg_id bigint, sent_at bigint, sent_hour_local int, sent_dow_local int, direction string, "
    "from_email_norm string, from_display_name string, reply_to_email_norm string, "
    "recipients array<string>, thread_id bigint, thread_depth int, size_bytes bigint, "
    "attachments array<struct<mime_type:string,extension:string,size_bytes:bigint>>, "
    "link_domains map<string,int>, links_extracted boolean, auth_spf string, auth_dkim string, "
    "auth_dmarc string"
)


def random_mailbox(seed, n=90, undated=True, in_order=False):
    r = random.Random(seed)
    people = [f"{p}@{d}" for d in DOMAINS for p in ("ann", "bob")]
    r.shuffle(people)
    busy = people[: r.randint(2, 4)]
    now, rows = 1_600_000_000, []
    times = []
    for _ in range(n):
        now += r.choice([0, 0, 60, 3600, DAY, DAY, 3 * DAY, 8 * DAY] + [120 * DAY] * (r.random() < 0.08))
        times.append(0 if undated and r.random() < 0.05 else now)
    if not in_order:
        for _ in range(n // 5):
            i, j = r.randrange(n), r.randrange(n)
            times[i], times[j] = times[j], times[i]
    for i in range(n):
        who = r.choice(busy) if r.random() < 0.7 else r.choice(people)
        out = r.random() < 0.12
        links = {f"site{r.randint(0, 5)}.net": r.randint(1, 9) for _ in range(r.choice([0, 0, 1, 2, 5]))}
        ext = r.choice(["pdf", "zip", "", "docx"])
        rows.append(
            {
                "msg_id": i + 1,
                "sent_at": times[i],
                "sent_hour_local": None if times[i] == 0 else r.choice([9, 9, 9, 10, 3]),
                "sent_dow_local": None if times[i] == 0 else i % 7,
                "direction": "out" if out else "in",
                "from_email_norm": "me@homestead.com" if out else who,
                "from_display_name": r.choice([None, "Ann", "Ann Lee", "B0b Ray", "Bob Ray", "x"]),
                "reply_to_email_norm": r.choice([None] * 4 + ["z@else.net", "y@other.org"]) if not out else None,
                "recipients": r.sample(people + ["me@homestead.com"], r.randint(0, 3)) if out else [],
                "thread_id": r.randint(1, 12),
                "thread_depth": r.randint(0, 3),
                "size_bytes": r.choice([0, 900, 1000, 1100, 1200, 5000, 3_000_000]),
                "attachments": [
                    {"mime_type": "application/" + (ext or "bin"), "extension": ext, "size_bytes": 5}
                ]
                if r.random() < 0.25
                else [],
                "link_domains": links,
                "links_extracted": r.random() < 0.9,
                "auth_spf": r.choice([None, "pass", "fail", "softfail"]),
                "auth_dkim": r.choice([None, "pass", "fail"]),
                "auth_dmarc": r.choice([None, "pass", "pass", "pass", "fail"]),
            }
        )
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)
