"""Operators for large text corpora: identification, quality, rules, licences, chat, urls, leaks, copies, mixing, secrets."""
