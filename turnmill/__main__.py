"""Command line: python -m turnmill posts|dialogues|sanitize|corpus|lda ..."""

from __future__ import annotations

import argparse
import json

from turnmill.plans import jobs
from turnmill.session import get_spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("turnmill")
    sub = p.add_subparsers(dest="command", required=True)

    a = sub.add_parser("posts", help="comments or submissions to posts")
    a.add_argument("--out_dir", required=True)
    a.add_argument("--output_prefix", default="posts")
    g = a.add_mutually_exclusive_group(required=True)
    for n in ("comments_file", "submissions_file", "comments_stream", "submissions_stream"):
        g.add_argument(f"--{n}")
    a.add_argument("--batch_size", type=int, default=100_000)
    a.add_argument("--min_chars", type=int, default=5)
    a.add_argument("--max_chars", type=int, default=150)
    a.add_argument("--max_words", type=int)
    a.add_argument("--min_words", type=int, default=2)
    a.add_argument("--subreddits")
    a.add_argument("--bots")
    a.add_argument("--emoticons")
    a.add_argument("--checkpoint")

    d = sub.add_parser("dialogues").add_subparsers(dest="action", required=True)
    for n in ("build", "lda"):
        x = d.add_parser(n)
        x.add_argument("--posts", required=True)
        x.add_argument("--output", required=True)
    x = d.add_parser("prepare")
    x.add_argument("--dialogue_data", required=True)
    x.add_argument("--num_turns", type=int, required=True)
    x.add_argument("--min_length", type=int, default=2)

    s = sub.add_parser("sanitize")
    s.add_argument("--data_file", required=True)
    s.add_argument("--profanity_file", required=True)

    c = sub.add_parser("corpus")
    c.add_argument("--data", required=True)
    c.add_argument("--separator", default="\t")
    c = c.add_subparsers(dest="action", required=True)
    x = c.add_parser("analyze")
    for n, v in (("n_frequents", -1), ("n_rares", -1), ("vocab_size", 0), ("min_freq", 1)):
        x.add_argument(f"--{n}", type=int, default=v)
    x.add_argument("--save_tf", action="store_true")
    x = c.add_parser("ngrams")
    x.add_argument("--ngrams", type=int, nargs="+", required=True)
    x.add_argument("--operation", choices=["count", "rank"], default="count")
    x = c.add_parser("preprocess-lda")
    x.add_argument("--output", required=True)
    for n, v in (("min_word_length", 3), ("min_utterance_length", 3), ("n_frequents_to_drop", 400)):
        x.add_argument(f"--{n}", type=int, default=v)
    x.add_argument("--ngrams_file")

    t = sub.add_parser("lda")
    t.add_argument("mode", choices=["train", "infer"])
    t.add_argument("--model_dir", required=True)
    t.add_argument("--data")
    t.add_argument("--n_topics", type=int, default=200)
    t.add_argument("--no_below", type=float, default=600)
    t.add_argument("--min_length", type=int)
    t.add_argument("--passes", type=int, default=70)
    t.add_argument("--test_data")
    t.add_argument("--dialogue_as_doc", action="store_true")
    t.add_argument("--output")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = get_spark()
    say = lambda x: print(json.dumps(x, default=str))
    if a.command == "posts":
        stream = bool(a.comments_stream or a.submissions_stream)
        found = jobs.ingest_posts(spark, f"{a.out_dir}/{a.output_prefix}", comments=a.comments_file or a.comments_stream, submissions=a.submissions_file or a.submissions_stream, subreddits=a.subreddits, bots=a.bots, emoticons=a.emoticons, max_chars=a.max_chars, max_words=a.max_words, min_words=a.min_words, stream=stream, checkpoint=a.checkpoint)
        if found is not None:
            say({r["reason"]: r["n"] for r in found.collect()})
    elif a.command == "dialogues" and a.action == "build":
        jobs.build_dialogues(spark, a.posts, a.output)
    elif a.command == "dialogues" and a.action == "lda":
        jobs.thread_documents(spark, a.posts, a.output)
    elif a.command == "dialogues":
        say({"output": jobs.prepare_windows(spark, a.dialogue_data, a.num_turns, a.min_length)})
    elif a.command == "sanitize":
        say(jobs.sanitize(spark, a.data_file, a.profanity_file))
    elif a.command == "corpus" and a.action == "analyze":
        say(jobs.analyze(spark, a.data, separator=a.separator, n_frequents=a.n_frequents, n_rares=a.n_rares, vocab_size=a.vocab_size, min_freq=a.min_freq, save_tf=a.save_tf))
    elif a.command == "corpus" and a.action == "ngrams":
        say([r.asDict() for r in jobs.ngrams(spark, a.data, a.ngrams, a.operation, a.separator).limit(100).collect()])
    elif a.command == "corpus":
        jobs.preprocess_lda(spark, a.data, a.output, min_word_length=a.min_word_length, min_utterance_length=a.min_utterance_length, n_frequents_to_drop=a.n_frequents_to_drop, ngrams_file=a.ngrams_file)
    elif a.mode == "train":
        jobs.train_topics(spark, a.data, a.model_dir, n_topics=a.n_topics, no_below=a.no_below, min_length=a.min_length, passes=a.passes)
    else:
        jobs.infer_topics(spark, a.test_data or a.data, a.model_dir, a.output, dialogue_as_doc=a.dialogue_as_doc)


if __name__ == "__main__":
    main()
