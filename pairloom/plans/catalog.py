"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import text as X
from pairloom.functions import vectors as V
from pairloom.functions.ngrams import kept_fragments
from pairloom.operators import corpus, ordering, overlap, pairs, phrases, retrieval, skipgram
from pairloom.plans import features, scorecards
from pairloom.plans import views as v
from pairloom.session import pinned, scratch_path
from pairloom.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 42


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits, so that sums in another order compare equal."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


# Scores of prediction tables

@query
def text_scorecard(spark, d):
    return rounded(scorecards.text_scorecard(v.turn_pairs(spark, d), X.alnum_words, tokenizer_name="alnum"))


@query
def text_scorecard_words(spark, d):
    """The default tokens for BLEU and METEOR, ROUGE's own for ROUGE."""
    return rounded(scorecards.text_scorecard(v.turn_pairs(spark, d)))


@query
def text_scorecard_by_role(spark, d):
    return rounded(scorecards.text_scorecard(v.turn_pairs(spark, d), X.alnum_words, group_by=["role"], tokenizer_name="alnum"))


@query
def bleu_corpus(spark, d):
    return rounded(scorecards.bleu_scorecard(v.eval_pairs(spark, d), X.alnum_words))


@query
def bleu_by_lang(spark, d):
    return rounded(scorecards.bleu_scorecard(v.eval_pairs(spark, d), X.alnum_words, group_by=["lang"]))


@query
def rouge_1_2(spark, d):
    return rounded(scorecards.rouge_scorecard(v.eval_pairs(spark, d)))


@query
def rouge_l(spark, d):
    tokens = v.eval_pairs(spark, d).select(
        "pair_id", X.alnum_words("ground_truth").alias("ref"), X.alnum_words("output").alias("hyp"))
    scored = overlap.with_rouge_l(tokens)
    return rounded(scored.select("pair_id", "rouge_l_p", "rouge_l_r", "rouge_l_f"))


@query
def rouge_l_turns(spark, d):
    tokens = v.turn_pairs(spark, d).select(
        "pair_id", X.alnum_words("ground_truth").alias("ref"), X.alnum_words("output").alias("hyp"))
    scored = overlap.with_rouge_l(tokens)
    return rounded(scored.select("pair_id", "rouge_l_p", "rouge_l_r", "rouge_l_f"))


@query
def meteor_exact(spark, d):
    tokens = v.eval_pairs(spark, d).select(
        "pair_id", X.alnum_words("ground_truth").alias("ref"), X.alnum_words("output").alias("hyp"))
    return rounded(overlap.with_meteor(tokens).select("pair_id", "meteor"))


@query
def meteor_stems(spark, d):
    """Exact and stem stages; a word's stem is its first four letters."""
    tokens = v.turn_pairs(spark, d).select(
        "pair_id", X.alnum_words("ground_truth").alias("ref"), X.alnum_words("output").alias("hyp"))
    every = tokens.select(F.explode(F.concat("ref", "hyp")).alias("word")).distinct()
    stems = every.select("word", F.substring("word", 1, 4).alias("form"))
    return rounded(overlap.with_meteor_stages(tokens, stems=stems).select("pair_id", "meteor"), 9)


@query
def char_bleu(spark, d):
    scored = overlap.with_character_overlap(v.eval_pairs(spark, d), "ground_truth", "output", 4)
    return rounded(scored.agg(F.count("*").alias("n_pairs"), overlap.bleu(overlap.BLEU4).alias("char_bleu")))


@query
def exact_match(spark, d):
    return rounded(v.eval_pairs(spark, d).agg(
        F.count("*").alias("n_pairs"),
        overlap.exact_rate(F.col("output"), F.col("ground_truth")).alias("exact_match"),
        overlap.exact_rate(F.col("output"), F.col("ground_truth"), F.col("valid")).alias("exact_match_valid"),
    ))


@query
def mean_levenshtein(spark, d):
    return rounded(v.turn_pairs(spark, d).agg(F.count("*").alias("n_pairs"), overlap.levenshtein_mean("output", "ground_truth").alias("levenshtein")))


@query
def molecule_scorecard(spark, d):
    return rounded(scorecards.molecule_scorecard(v.turn_pairs(spark, d), key=F.lower, valid=F.col("role") != "system"))


@query
def validity(spark, d):
    return rounded(scorecards.validity_scorecard(v.eval_pairs(spark, d), F.col("lang") != "de", F.col("valid")))


@query
def uniqueness(spark, d):
    return rounded(v.eval_pairs(spark, d).groupBy("lang").agg(
        overlap.uniqueness_rate(F.col("output"), F.col("valid")).alias("uniqueness")))


# Preference, instruction and chat tables

@query
def preference_triples(spark, d):
    return v.triples(spark, d)


@query
def union_directions(spark, d):
    p, predicted = v.text_pairs(spark, d), v.predictions(spark, d)
    union = pairs.both_directions(
        pairs.preference_triples(p, predicted, "smiles2caption"), pairs.preference_triples(p, predicted, "caption2smiles"))
    return union.groupBy(X.task_of("source").alias("task")).agg(
        F.count("*").alias("n"), F.sum(F.length(X.unmarked("source"))).alias("source_chars"),
        F.sum(F.length("chosen")).alias("chosen_chars"), F.sum(F.length("rejected")).alias("rejected_chars"))


@query
def marker_rejects(spark, d):
    """Generated texts carry no marker: all of them are rejects."""
    return pairs.rejects(v.raw_outputs(spark, d), "output")


@query
def dpo_prompts(spark, d):
    return pairs.ranking_prompts(v.triples(spark, d))


@query
def kto_unpivot(spark, d):
    return pairs.unpivoted(v.triples(spark, d))


@query
def kto_chat_texts(spark, d):
    return pairs.feedback_texts(v.triples(spark, d))


@query
def sft_instructions(spark, d):
    return pairs.instructions(v.triples(spark, d))


@query
def sft_texts(spark, d):
    return pairs.instruction_texts(v.triples(spark, d))


@query
def reward_pairs(spark, d):
    return pairs.ranked_texts(v.triples(spark, d))


@query
def inference_prompts(spark, d):
    return pairs.inference_prompts(v.text_pairs(spark, d), "smiles2caption")


@query
def prefix_prompts(spark, d):
    return pairs.inference_prompts(v.text_pairs(spark, d), "caption2smiles", style="prefix")


@query
def task_union(spark, d):
    return pairs.task_union(v.text_pairs(spark, d))


@query
def task_chats(spark, d):
    return pairs.task_chats(v.text_pairs(spark, d))


@query
def chat_messages(spark, d):
    """Each question turn with its answer as a chat, rendered."""
    from pairloom.functions import prompts

    chats = prompts.chat(prompts.message("user", "ground_truth"), prompts.message("assistant", "output"))
    return v.turn_pairs(spark, d).where(F.col("role") == "user").select("pair_id", prompts.chat_text(chats).alias("chat"))


@query
def length_percentiles(spark, d):
    prompted = pairs.ranking_prompts(v.triples(spark, d))
    return pairs.pair_lengths(prompted, X.word_count, 95)


@query
def longest_lengths(spark, d):
    t, e = v.triples(spark, d), pairs.ranking_prompts
    split = lambda task: e(t.where(X.task_of("source") == task))
    return pairs.longest_of_splits(
        pairs.pair_lengths(split("mol2cap"), X.word_count), pairs.pair_lengths(split("cap2mol"), X.word_count))


@query
def scored_batches(spark, d):
    """Prompts through a caller's batch function, its texts joined back to the prediction table."""
    def predict(batch):
        return batch[["pair_id"]].assign(output=batch["prompt"].str.replace("e", "3", regex=False))

    prompted = pairs.inference_prompts(v.text_pairs(spark, d), "smiles2caption")
    return pairs.prediction_table(prompted, pairs.score_batches(prompted, predict, "pair_id bigint, output string"))


@query
def dedupe_first(spark, d):
    return pairs.first_per_key(v.text_pairs(spark, d), "molecule", "caption", "pair_id")


@query
def holdout_anti(spark, d):
    """Documents whose text does not occur among the labelled documents."""
    docs = v.documents(spark, d)
    labelled = docs.join(readers.read_table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return pairs.excluding(docs.select("doc_id", "text"), labelled, "text", ["doc_id"]).select("doc_id")


@query
def seeded_shuffle(spark, d):
    docs = v.documents(spark, d).select("doc_id")
    return ordering.with_position(docs, [ordering.shuffle_key("doc_id", SEED), F.col("doc_id")])


@query
def seeded_sample(spark, d):
    return ordering.sample_rows(v.documents(spark, d).select("doc_id", "lang"), "doc_id", n=300, seed=SEED)


@query
def fraction_sample(spark, d):
    return ordering.sample_rows(v.documents(spark, d).select("doc_id", "lang"), "doc_id", fraction=0.1, seed=SEED)


# Clean-up

@query
def strip_cls(spark, d):
    return v.raw_outputs(spark, d).select("pair_id", X.without_leading_mark("output").alias("output"))


@query
def clean_outputs_a(spark, d):
    bare = X.without_leading_mark("output")
    return v.raw_outputs(spark, d).select(
        "pair_id", X.cleaned(bare).alias("output"), X.cleaned(bare, strip_hash=True).alias("without_hash"),
        X.unlisted(bare).alias("parsed"))


@query
def clean_outputs_b(spark, d):
    return v.raw_outputs(spark, d).select(
        "pair_id", X.cleaned_first_word(X.without_leading_mark("output")).alias("output"))


# Phrase metrics

@query
def contained_outputs(spark, d):
    """Whether the words of the output stand in the words of the source, one after another."""
    p = v.eval_pairs(spark, d)
    return p.select("pair_id", X.contains_phrase(X.words("output"), X.words("source")).alias("contained"))


@query
def special_tokens(spark, d):
    """Spaced tokens between marks, cut at 512, marks dropped."""
    marked = F.concat(F.lit("[CLS] "), "ground_truth", F.lit(" [SEP] [PAD]"))
    kept = X.without_special(X.truncated(F.split(marked, " "), X.MAX_TEXT_TOKENS))
    return v.eval_pairs(spark, d).select("pair_id", F.array_join(kept, " ").alias("tokens"), F.size(kept).alias("n_tokens"))


@query
def nested_counts(spark, d):
    """True positives of every property as one JSON tree."""
    return phrases.nested(phrases.confusion(v.eval_pairs(spark, d), v.properties(spark, d)), "tp")


@query
def flatten_tree(spark, d):
    return readers.flat_tree(v.property_trees(spark, d), "tree", ["prop_id"])


@query
def property_confusion(spark, d):
    return rounded(phrases.confusion(v.eval_pairs(spark, d), v.properties(spark, d)))


@query
def property_macro(spark, d):
    return rounded(phrases.macro_average(phrases.confusion(v.eval_pairs(spark, d), v.properties(spark, d))))


@query
def combo_metrics(spark, d):
    return rounded(phrases.combo_confusion(v.eval_pairs(spark, d), v.combos(spark, d)))


@query
def combo_metrics_compat(spark, d):
    return rounded(phrases.combo_confusion(v.eval_pairs(spark, d), v.combos(spark, d), compat=True))


@query
def heldout_rows(spark, d):
    return phrases.heldout_rows(v.eval_pairs(spark, d), v.combos(spark, d))


@query
def heldout_rows_by_source(spark, d):
    return phrases.heldout_rows(v.eval_pairs(spark, d), v.combos(spark, d), on="source")


@query
def property_report(spark, d):
    return rounded(scorecards.property_report(v.eval_pairs(spark, d), v.properties(spark, d), v.combos(spark, d)))


# Vectors and fingerprints

@query
def paired_cosine(spark, d):
    return rounded(v.vec_pairs(spark, d).select("pair_id", V.cosine("a", "b").alias("similarity")))


@query
def negative_cosine(spark, d):
    return rounded(scorecards.embedding_scorecard(v.vec_pairs(spark, d)))


@query
def topk_retrieval(spark, d):
    corpus_vecs = v.embeddings(spark, d).select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"))
    found = retrieval.retrieve(v.centroids(spark, d), corpus_vecs, 20)
    labels = v.embeddings(spark, d).select(F.col("vec_id").alias("item"), F.concat(F.lit("label "), "label").alias("description"))
    return rounded(retrieval.described(found, labels).select("query", "item", "score", "rank", "description"))


@query
def rank_all(spark, d):
    corpus_vecs = v.embeddings(spark, d).select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"))
    scored = retrieval.cosine_scores(v.centroids(spark, d), corpus_vecs)
    return rounded(retrieval.ranked(scored).select("query", "item", "score", "rank"))


@query
def rank_asked(spark, d):
    """The place of every vector among all vectors by closeness to the mean of its label."""
    e = v.embeddings(spark, d).select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"), "label")
    asked = e.select(F.col("label").alias("query"), "item")
    return rounded(retrieval.ranks_of(asked, v.centroids(spark, d), e.select("item", "vec")))


@query
def union_splits(spark, d):
    e = v.embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    part = lambda test: e.where(test).select("id", "vec")
    every = retrieval.all_splits(train=part(F.col("label") < 8), val=part(F.col("label") == 8), test=part(F.col("label") > 8))
    return rounded(every.select("id", "split", V.norm("vec").alias("length")))


@query
def tanimoto_bits(spark, d):
    """Sign bits of the vectors as 32-bit words."""
    def bits(c: str) -> Column:
        word = lambda at: F.aggregate(
            F.slice(c, at, 32), F.lit(0).cast("bigint"),
            lambda acc, x: F.shiftleft(acc, 1) + F.when(x > 0, 1).otherwise(0))
        starts = F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)), F.lit(32))
        return F.transform(starts, word)

    p = v.vec_pairs(spark, d).select("pair_id", bits("a").alias("a"), bits("b").alias("b"))
    return rounded(p.select("pair_id", V.tanimoto_bits("a", "b").alias("similarity")))


@query
def tanimoto_counts(spark, d):
    scored = overlap.with_overlap(
        v.eval_pairs(spark, d), X.alnum_words("ground_truth"), X.alnum_words("output"), 1)
    return rounded(scored.select("pair_id", overlap.tanimoto_from_matches().alias("similarity")))


@query
def fingerprint_scorecard(spark, d):
    p = overlap.with_overlap(v.eval_pairs(spark, d), X.alnum_words("ground_truth"), X.alnum_words("output"), 1)
    sims = {"set_similarity": V.tanimoto_sets("ref", "hyp"), "count_similarity": overlap.tanimoto_from_matches()}
    return rounded(scorecards.fingerprint_scorecard(p, sims, F.col("valid")))


@query
def vector_blend(spark, d):
    p = v.vec_pairs(spark, d)
    first = p.select(F.col("pair_id").alias("key"), F.col("a").alias("vec"))
    second = p.select(F.col("pair_id").alias("key"), F.col("b").alias("vec"))
    return rounded(retrieval.blended(first, second, 0.25).select("key", V.total(F.col("vec")).alias("total"), V.norm("vec").alias("length")))


def _keyed(spark, d):
    e = v.embeddings(spark, d)
    return e.select(F.col("label").alias("key"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))


@query
def vector_lookup(spark, d):
    rows = v.eval_pairs(spark, d).select("pair_id", (F.size(X.alnum_words("output")) % 12).alias("n_words"))
    found = retrieval.with_vectors(rows, _keyed(spark, d), "n_words", "vec_id", ["pair_id"])
    return rounded(found.select("pair_id", "n_words", V.norm("vec").alias("length")))


@query
def vector_lookup_misses(spark, d):
    rows = v.eval_pairs(spark, d).select("pair_id", (F.size(X.alnum_words("output")) % 12).alias("n_words"))
    return retrieval.lookup_misses(rows, _keyed(spark, d), "n_words")


# Corpus features

def _sentences(spark, d):
    return v.documents(spark, d).select(F.col("doc_id").alias("sent_id"), X.alnum_words("text").alias("words"))


@query
def word_counts(spark, d):
    return corpus.word_counts(_sentences(spark, d))


@query
def rare_to_unk(spark, d):
    s = corpus.with_unknown(_sentences(spark, d))
    return s.select("sent_id", F.array_join("words", " ").alias("sentence"))


@query
def ngram_sentences(spark, d):
    s = corpus.corpus_sentences(_sentences(spark, d), F.col("words"), 1, "all")
    return s.select("sent_id", "kind", F.array_join("words", " ").alias("sentence"))


@query
def fragment_filter(spark, d):
    n_words = lambda f: F.size(X.alnum_words(f))
    return v.documents(spark, d).select(
        "doc_id", kept_fragments("text", 3, n_words).alias("large"), kept_fragments("text", 3, n_words, "small").alias("small"))


def _summary(vecs: DataFrame, key: str) -> DataFrame:
    """Two numbers that fix a long vector well enough to compare it."""
    places = F.transform("vec", lambda x, i: x * (i + 1))
    return rounded(vecs.select(key, V.total(F.col("vec")).alias("total"), V.total(places).alias("weighted")), 3)


@query
def sentence_vectors(spark, d):
    s = _sentences(spark, d)
    return _summary(corpus.sentence_vectors(s, pinned(v.word_table(spark, d, corpus.word_counts(s)))), "sent_id")


def _elements(vecs: DataFrame, key: str) -> DataFrame:
    """Every element of the vector to three digits, as text."""
    digits = F.transform("vec", lambda x: x.cast("decimal(18,3)").cast("string"))
    return vecs.select(key, F.array_join(digits, " ").alias("vec"))


@query
def sentence_vector_elements(spark, d):
    s = _sentences(spark, d)
    return _elements(corpus.sentence_vectors(s, pinned(v.word_table(spark, d, corpus.word_counts(s)))), "sent_id")


@query
def sentence_vectors_unknown(spark, d):
    s = _sentences(spark, d)
    known = pinned(v.word_table(spark, d, corpus.word_counts(s)))
    unknown = v.embeddings(spark, d).groupBy().agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("vec"))
    table = known.unionByName(unknown.select(F.lit(corpus.UNKNOWN).alias("word"), "vec"))
    return _summary(corpus.sentence_vectors(s, table, corpus.UNKNOWN), "sent_id")


@query
def featurize(spark, d):
    docs = v.documents(spark, d).select(F.col("doc_id").alias("sent_id"), "text")
    words = X.alnum_words("text")
    counts = pinned(corpus.word_counts(corpus.corpus_sentences(docs, words, 1, "alt")))
    out = features.featurize(docs, words, pinned(v.word_table(spark, d, counts)), counts=counts)
    return _summary(out, "sent_id")


@query
def word2vec_fit(spark, d):
    model = corpus.fit_word_vectors(_sentences(spark, d), vector_size=16, window=5, seed=SEED)
    return corpus.word_vectors(model).select("word", F.size("vec").alias("width"))


@query
def skipgram_fit(spark, d):
    """Vectors trained without a vocabulary on the driver: every frequent word has one of the asked width."""
    vecs = skipgram.train_skipgram(_sentences(spark, d), vector_size=16, window=2, rounds=2, seed=SEED)
    return vecs.select("word", F.size("vec").alias("width"))


@query
def neighbour_counts(spark, d):
    """How often two words of the corpus stand at most two places apart, words below the least count left out."""
    s = _sentences(spark, d)
    vocabulary = corpus.word_ids(corpus.word_counts(s).where(F.col("n") > 20))
    return skipgram.pair_counts(corpus.token_ids(s, vocabulary, F.col("words"), row_id="sent_id"), window=2)


@query
def vocabulary_ids(spark, d):
    return corpus.word_ids(corpus.word_counts(_sentences(spark, d)))


@query
def pad_truncate_ids(spark, d):
    s = _sentences(spark, d)
    vocabulary = corpus.word_ids(corpus.word_counts(s).where(F.col("n") > corpus.RARE_COUNT))
    ids = corpus.token_ids(s, vocabulary, F.col("words"), X.MAX_PAIR_TOKENS, row_id="sent_id")
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return ids.select(
        "sent_id", text(X.padded("ids", X.MAX_PAIR_TOKENS, 0)).alias("input_ids"),
        F.aggregate(X.attention("ids", X.MAX_PAIR_TOKENS), F.lit(0), lambda a, b: a + b).alias("n_attended"))


@query
def reward_token_ids(spark, d):
    vocabulary = corpus.word_ids(corpus.word_counts(_sentences(spark, d)).where(F.col("n") > corpus.RARE_COUNT))
    triples = pairs.preference_triples(v.text_pairs(spark, d), v.predictions(spark, d), "caption2smiles")
    ids = corpus.tokenised_pairs(pairs.ranked_texts(triples), vocabulary, X.alnum_words, X.MAX_PAIR_TOKENS, 0)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return ids.select("pair_id", *[text(c).alias(c) for c in ids.columns[1:]])


# Files: written to the shared folder and read back

@query
def prediction_file(spark, d):
    path = scratch_path(spark, "predictions")
    writers.write_predictions(v.eval_pairs(spark, d), path, "smiles2caption")
    return readers.read_predictions(spark, path, "smiles2caption").select("source", "ground_truth", "output")


@query
def triple_file(spark, d):
    path = scratch_path(spark, "triples")
    # Every text stands in six fields; files with multi-line fields are read whole either way.
    writers.write_csv(v.triples(spark, d), path, compression="gzip")
    return readers.read_triples(spark, path).select("source", "chosen", "rejected")


@query
def record_file(spark, d):
    path = scratch_path(spark, "records.sdf")
    writers.write_records(v.eval_pairs(spark, d).select(F.col("ground_truth").alias("GT_SMI"), F.col("pair_id").alias("ID")), ["GT_SMI", "ID"], path)
    return readers.read_records(spark, path, ["ID", "GT_SMI"]).select(F.col("ID").cast("bigint").alias("pair_id"), F.col("GT_SMI").alias("ground_truth"))


@query
def id_file(spark, d):
    path = scratch_path(spark, "ids.smi")
    writers.write_lines(v.eval_pairs(spark, d), ["output", "pair_id"], path)
    return readers.read_ids(spark, path).select(F.col("name").cast("bigint").alias("pair_id"), F.col("id").alias("output"))


@query
def corpus_file(spark, d):
    path = scratch_path(spark, "corpus")
    writers.write_sentences(_sentences(spark, d), path)
    return corpus.word_counts(readers.read_corpus(spark, path))


@query
def wide_vector_file(spark, d):
    path = scratch_path(spark, "vectors")
    e = v.embeddings(spark, d)
    width = e.select(F.size("embedding")).first()[0]
    writers.write_csv(e.select(
        F.lit("").alias("row"), "label", F.lit("x").alias("note"), "vec_id",
        *[F.get(F.col("embedding").cast("array<double>"), i).alias(f"mol2vec-{i:03d}") for i in range(width)]), path)
    back = readers.read_wide_vectors(spark, path, width)
    return rounded(back.select(F.col("key").cast("bigint").alias("vec_id"), V.norm("vec").alias("length")))


@query
def feature_file(spark, d):
    """Records file to feature file: texts read back, featurised, one column per element, written and read back."""
    records, path = scratch_path(spark, "records.sdf"), scratch_path(spark, "features")
    writers.write_records(v.documents(spark, d).select(F.col("doc_id").alias("ID"), F.regexp_replace("text", r"\s+", " ").alias("TEXT")), ["ID", "TEXT"], records)
    # Read three times below: the records are taken apart once.
    rows = pinned(readers.read_records(spark, records, ["ID", "TEXT"]).select(F.col("ID").cast("bigint").alias("sent_id"), F.col("TEXT").alias("text")))
    words = X.alnum_words("text")
    counts = pinned(corpus.word_counts(corpus.corpus_sentences(rows, words, 1, "alt")))
    table = pinned(v.word_table(spark, d, counts))
    width = table.agg(F.max(F.size("vec"))).first()[0] or 0
    writers.write_csv(features.feature_columns(features.featurize(rows, words, table, counts=counts).drop("text"), width), path)
    back = readers.read_wide_vectors(spark, path, width, key_index=0)
    return _elements(back.select(F.col("key").cast("bigint").alias("sent_id"), F.transform("vec", lambda x: F.coalesce(x, F.lit(0.0))).alias("vec")), "sent_id")


@query
def public_split(spark, d):
    """All turns as the train split of a dataset folder, read back with other names."""
    path = scratch_path(spark, "dataset")
    v.conversations(spark, d).write.parquet(f"{path}/train")
    return readers.read_public_split(spark, path, "train", {"conv_id": "chat", "turn": "place", "text": "content"})


@query
def row_numbers(spark, d):
    """Lines written in the order of their ids: the reader's row ids give that order back."""
    path = scratch_path(spark, "lines.smi")
    docs = v.documents(spark, d).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "doc_id")
    writers.write_lines(docs.orderBy("doc_id"), ["digest", "doc_id"], path)
    placed = ordering.with_position(readers.read_ids(spark, path), [F.col("row_id")])
    return placed.select(F.col("name").cast("bigint").alias("doc_id"), F.col("id").alias("digest"), "position")


@query
def combo_file(spark, d):
    path = scratch_path(spark, "combos")
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    lines = v.combos(spark, d).select(F.concat(F.lit("("), quoted("p1"), F.lit(", "), quoted("p2"), F.lit(")")).alias("pair"), "combo_id")
    writers.write_lines(lines, ["pair", "combo_id"], path)
    return readers.read_combos(spark, path).select("p1", "p2")


@query
def report_file(spark, d):
    path = scratch_path(spark, "report")
    writers.write_report(phrases.macro_average(phrases.confusion(v.eval_pairs(spark, d), v.properties(spark, d))), path)
    return rounded(spark.read.parquet(path))
