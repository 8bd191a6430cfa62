"""Sentences with and without personal data or secrets, written for the tests by hand from public formats.

They share no code with the examples that the trees are fitted on. Secrets are put together from their formats, so
that the repository holds none.
"""

import base64
import json
import random
import string

# Each: a sentence that has one piece of personal data beyond the base formats.
PRIVATE = [
    "You can reach our office manager on (415) 555-0132 until five.",
    "Her mobile is 07700 900 461, but she seldom answers.",
    "Fax the signed form to 212-555-0187 before Friday.",
    "For bookings phone 020 7946 0018 and ask for Marta.",
    "Telefon: 030 901820 33, Zimmer 12",
    "tel. 01 42 68 53 00, fermé le lundi",
    "He left his cell number, 303.555.0171, with the nurse.",
    "If nobody answers, call 8005550199 and leave a message.",
    "WhatsApp me: 5551234567",
    "ring 0 1 6 1 4 9 6 0 0 0 0 after six",
    "contact Jonas at jonas.b [at] posteo [dot] de about the flat",
    "write to info(at)kleingarten-nord(dot)org for a plot",
    "her address is lena at fastpost dot net, lower case",
    "mail bob{at}northlake{dot}edu with your results",
    "Please e-mail a.novak [at] uni-ostrava [dot] cz by Monday",
    "The applicant's SSN is 219-09-9999 and must be masked.",
    "social security number: 078-05-1120",
    "Date of birth: 14/03/1962, place of birth Lyon",
    "The patient, born 02.11.1948, was admitted on Tuesday.",
    "dob 7/9/1985, male",
    "Transfer the deposit to IBAN DE89 3704 0044 0532 0130 00 this week.",
    "iban: GB82WEST12345698765432",
    "pay to FR76 3000 6000 0112 3456 7890 189",
    "account number 004218839921 at the savings bank",
    "My bank account is 4402 118 8837, please don't share it",
    "Passport no. 533380006, issued in Leeds",
    "tax id 912778344 was given by the agent",
    "national id 8001015009087 copied from the card",
    "The client 2001:0db8:85a3:0000:0000:8a2e:0370:7334 kept reconnecting.",
    "last login from host fe80:1a2b:3c4d:5e6f:7a8b:9c0d:1e2f:3a4b",
    "insurance number 774210938 on the back of the card",
    "driver's license 40218837 expired in June",
]

# Each: a sentence with something that looks like it.
HARMLESS = [
    "The museum had 1 204 331 visitors between 1998 and 2004.",
    "See pages 112-118 and figure 3.4-12 for the full derivation.",
    "We upgraded from version 10.4.1.7 to release 11.0.2 last night.",
    "ISBN 978-0-306-40615-7 is out of print.",
    "Order 5500182734 shipped on 2021-03-14.",
    "The match ended 21-19, 18-21, 21-15 after two hours.",
    "Meeting at 10:15:30:00 on the studio clock",
    "Invoice no. 20240117 totals 1,250.00 EUR.",
    "The river is 1 345 km long and 210 m wide.",
    "Between 1914-1918 and 1939-1945 the factory was closed.",
    "Population 8336817 according to the census",
    "The checksum field holds 16777216 in each header.",
    "unix time 1700000000 passed unnoticed",
    "He scored 10 12 9 14 8 11 points in six games.",
    "The ratio 16:9:4 was printed on the lid.",
    "ticket 100200300 was closed as a duplicate",
    "coordinates 48.8566 and 2.3522 mark the square",
    "Use screws of 3.5 x 35 mm, part number 70012345.",
    "we met at noon. then we walked home",
    "looking at example.org or at any other page",
    "She arrived at home dot exactly at nine",
    "Chapter 12.3.4.1 covers the 1848 revolutions.",
    "The build 20230915123456 failed twice.",
    "On 12/05/2019 the council voted 14-3.",
    "prices rose 3.5 - 4.25 percent in 2017/2018",
    "Model AB12 CDEF GHIJ KLM is sold out",
    "Room 101, 102 and 103 are on floor 1.",
    "about 7000000 bytes were lost",
    "Bible verses 3:16-18 and 4:7-9",
    "It cost $1200.50 in 1987, or 45.99 a month.",
    "lines 100-250 of the log repeat",
    "serial 99887766 is engraved below",
]


def secrets(seed: int = 11) -> list[str]:
    """Texts with one secret each that no base format finds."""
    rnd = random.Random(seed)
    pick = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    alnum, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    b64 = lambda n: base64.b64encode(rnd.randbytes(n)).decode()
    url64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    jwt = lambda: ".".join([url64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url64(json.dumps({"sub": pick(alnum, 9)}).encode()), url64(rnd.randbytes(32))])
    makes = [
        lambda: f"Authorization: Bearer {pick(alnum + '_-', 40)}",
        lambda: f"curl -H 'Authorization: Basic {b64(27)}' https://host/",
        lambda: f"export GH=ghp_{pick(alnum, 36)}",
        lambda: f"bot: xoxb-{pick(string.digits, 12)}-{pick(alnum, 24)}",
        lambda: f"stripe sk_live_{pick(alnum, 24)}",
        lambda: f"key=AIza{pick(alnum + '_-', 35)}&q=1",
        lambda: f"cookie {jwt()}",
        lambda: f"ssh-rsa {b64(60)} me@host",
        lambda: "-----BEGIN KEY-----\n" + b64(48) + "\n" + b64(48),
        lambda: f"pat {pick(string.ascii_lowercase + string.digits, 52)}",
        lambda: f"the digest key is {pick('0123456789ABCDEF', 40)}",
        lambda: f"seed: {pick(upper, 32)}",
    ]
    return [rnd.choice(["see ", "note: ", "", "config\n"]) + make() + rnd.choice([" here", ".", "\nnext"]) for make in makes for _ in range(8)]


def lookalikes(seed: int = 12) -> list[str]:
    """Texts with long runs of key characters that are no secrets."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    hexs = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    makes = [
        lambda: "/".join(word() for _ in range(6)),
        lambda: "https://host.org/" + "-".join(word() for _ in range(6)),
        lambda: "the" + "".join(word().title() for _ in range(5)) + "Factory",
        lambda: "_".join(word() for _ in range(5)).upper(),
        lambda: f"sha256:{hexs(64)}",
        lambda: "-".join(hexs(n).upper() for n in (8, 4, 4, 4, 12)),
        lambda: "=" * 40 + " " + "-" * 40,
        lambda: f"{rnd.randint(10**19, 10**20)}-{rnd.randint(10**9, 10**10)}",
        lambda: "2024-01-02/2024-02-03/2024-03-04",
        lambda: "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
        lambda: "ABCDEFGHxxxxxxxx12345678xxxxxxxx",
        lambda: "src/" + word() + "/" + word() + "Test/" + word() + "Helper/" + word(),
    ]
    return ["see " + make() + " there" for make in makes for _ in range(8)]
