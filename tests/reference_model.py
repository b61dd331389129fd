"""A scalar model of redaction and restoration, to check the expressions against.

Plain Python over one text at a time, written from the semantics: patterns in
order, tokens per distinct value, later patterns see earlier tokens.
"""

import re

from palimpsest.functions.patterns import CATALOG


def model_regex(pattern):
    """RE2 semantics in Python's dialect: ASCII classes, \\s without the vertical tab."""
    body = pattern.regex.replace(r"[^\s]", "[^\t\n\f\r ]")
    body = re.sub(r"(\[[^\]]*)\\s", lambda m: m.group(1) + "\t\n\f\r ", body)
    body = body.replace(r"\s", "[\t\n\f\r ]")
    return re.compile(body, re.ASCII)


REGEXES = {p.name: model_regex(p) for p in CATALOG}


class Scope:
    def __init__(self):
        self.values, self.tokens, self.numbers = [], [], {}

    def token(self, category, value):
        if value in self.values:
            return self.tokens[self.values.index(value)]
        self.numbers[category] = self.numbers.get(category, 0) + 1
        token = f"[TG:{category}:{self.numbers[category]}]"
        self.values.append(value)
        self.tokens.append(token)
        return token

    def redact(self, text, patterns):
        counts = {}
        for p in patterns:
            def put(m, p=p):
                value = m.group(p.group)
                if not value:
                    return m.group(0)
                counts[p.name] = counts.get(p.name, 0) + 1
                start = m.start(p.group) - m.start()
                end = m.end(p.group) - m.start()
                return m.group(0)[:start] + self.token(p.category, value) + m.group(0)[end:]

            text = REGEXES.get(p.name, None).sub(put, text) if p.name in REGEXES else re.sub(p.regex, put, text)
        return text, counts

    def restore(self, text):
        for _ in range(11):
            text = re.sub(r"\[TG:[A-Z]+:\d+\]", lambda m: dict(zip(self.tokens, self.values)).get(m.group(0), m.group(0)), text)
        return text
