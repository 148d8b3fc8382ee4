"""Training-data operators (licences, fixity, secrets, chat, decontamination,
mixing, toxicity, token shards, media, near-duplicates).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
