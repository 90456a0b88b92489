import base64
import datetime
import json
import uuid

from conftest import rows

from pricelens.sources import tables
from pricelens.streaming import events

RECEIPT = "MARCHE BLEU\n3 rue Y\n02/02/2024 10:00\nSAVON DOUX   2,40 €\nTOTAL 2,40"
START = datetime.datetime(2026, 5, 20, tzinfo=datetime.timezone.utc)


def ident(n):
    return str(uuid.UUID(int=n))


def envelope(name, mid, at="2026-05-17T03:00:00Z", data=None):
    body = base64.b64encode(json.dumps({"bucket": "b", "name": name}).encode()).decode() if data is None else data
    message = {"attributes": {"eventType": "OBJECT_FINALIZE"}, "data": body, "messageId": mid}
    return json.dumps({"message": message | ({"publishTime": at} if at else {}), "subscription": "s"})


def upload(n, mid, at="2026-05-17T03:00:00Z", user="u1"):
    return envelope(f"tickets/raw/{user}/{uuid.UUID(int=n).hex}.jpg", mid, at)


class Chain:
    """A stream over an inbox, with a clock and texts that a test moves on."""

    def __init__(self, spark, folder):
        self.spark, self.inbox, self.base, self.now, self.texts, self.files = spark, folder / "in", str(folder / "out"), START, {}, 0
        self.inbox.mkdir()

    def given(self):
        return self.spark.createDataFrame([(ident(n), text) for n, text in self.texts.items()], "ticket_id string, text string")

    def deliver(self, *lines):
        (self.inbox / f"{self.files}.json").write_text("\n".join(lines))
        self.files += 1
        query = events.run_ticket_stream(tables.stream_ticket_events(self.spark, str(self.inbox)), self.given, self.base, clock=lambda: self.now)
        query.awaitTermination(120)
        assert query.exception() is None

    def wait(self, **time):
        self.now += datetime.timedelta(**time)
        events.attempt(self.spark, self.given(), self.base, self.now)

    def read(self, table):
        return self.spark.read.parquet(f"{self.base}/{table}")

    def states(self):
        return {uuid.UUID(r.ticket_id).int: (r.status, r.attempts) for r in self.read("tickets").collect()}

    def messages(self, table):
        return sorted(r.messageId for r in self.read(table).collect())


def test_every_event_is_claimed_repeated_or_dead(spark, tmp_path):
    """Old, untimed and repeated deliveries over three batches, and one batch that runs again."""
    chain = Chain(spark, tmp_path)
    chain.texts = {n: RECEIPT for n in range(1, 7)}
    chain.deliver(upload(1, "a"), upload(1, "b", "2026-05-17T02:00:00Z"), envelope("", "c", data="%%"), envelope("tickets/raw/u1/bad.jpg", "d"), envelope("other/x", "e"))
    chain.deliver(upload(2, "f", "2026-05-08T03:00:00Z"), upload(3, "g", None), upload(1, "b", "2026-05-17T02:00:00Z"), envelope("tickets/raw/u1/bad.jpg", "h", None), upload(4, "i", "no time"))
    chain.deliver(upload(2, "j", "2026-05-19T03:00:00Z"), upload(3, "g", None), upload(5, "k", "2026-05-17T03:00:00Z"), upload(5, "l", None), upload(1, "m", None))
    assert chain.messages("claims") == ["b", "f", "g", "i", "k"]
    assert chain.messages("repeats") == ["a", "b", "g", "j", "l", "m"]
    assert sorted(json.loads(r.message)["messageId"] for r in chain.read("dead").collect()) == ["c", "d", "h"]
    assert chain.states() == {n: ("done", 1) for n in range(1, 6)}
    again = [r.asDict() for r in chain.read("claims").where("batch = 2").collect()]
    valid = spark.createDataFrame([("b", r["path"], r["ticket_id"], r["user_id"], r["published_at"], r["messageId"]) for r in again], "bucket string, path string, ticket_id string, user_id string, published_at timestamp, messageId string")
    assert [r.messageId for r in events.claim_events(valid, chain.base, 2).collect()] == ["k"]


def test_tickets_pass_all_states(spark, tmp_path):
    chain = Chain(spark, tmp_path)
    events.register(spark.createDataFrame([(ident(1), "u1", "pending"), (ident(2), "u1", "uploaded"), (ident(3), "u1", "pending")], "ticket_id string, user_id string, status string"), chain.base)
    chain.texts = {3: RECEIPT, 5: "  "}
    chain.deliver(upload(3, "a"), upload(4, "b"), upload(5, "c"))
    assert chain.states() == {1: ("pending", None), 2: ("uploaded", None), 3: ("done", 1), 4: ("processing", 1), 5: ("failed", 1)}
    chain.texts |= {4: RECEIPT, 2: RECEIPT}
    chain.now += datetime.timedelta(seconds=11)
    chain.deliver(upload(4, "d", "2026-05-18T03:00:00Z"), upload(2, "e"))
    assert chain.states() == {1: ("pending", None), 2: ("done", 1), 3: ("done", 1), 4: ("done", 2), 5: ("failed", 1)}
    events.register(spark.createDataFrame([(ident(3), "u1", "pending")], "ticket_id string, user_id string, status string"), chain.base)
    assert chain.states()[3] == ("done", 1)
    assert rows(chain.read("lines").groupBy("ticket_id").count()) == [(ident(n), 1) for n in (2, 3, 4)]
    assert rows(chain.read("tickets").where("status = 'failed'").select("error")) == [("empty text",)]
    assert chain.read("queue").count() == 0


def test_attempts_wait_and_end_as_letters(spark, tmp_path):
    chain = Chain(spark, tmp_path)
    chain.deliver(upload(1, "a"), upload(2, "b"))
    waits = []
    for k in range(2, 6):
        wait = {int((r.next_at.replace(tzinfo=None) - chain.now.replace(tzinfo=None)).total_seconds()) for r in chain.read("queue").collect()}
        waits += wait
        before = chain.states()
        chain.wait(seconds=max(wait) - 1)
        assert chain.states() == before  # not yet
        if k == 4:
            chain.texts[2] = RECEIPT
        chain.wait(seconds=1)
        assert chain.states()[1] == ("processing" if k < 5 else "failed", k)
    assert waits == [10, 20, 40, 80] and chain.states()[2] == ("done", 4)
    assert rows(chain.read("letters").select("ticket_id", "attempts")) == [(ident(1), 5)] and chain.read("queue").count() == 0
    assert rows(chain.read("tickets").where("status = 'failed'").select("error")) == [("no text after 5 attempts",)]
    chain.wait(days=7)
    assert chain.read("letters").count() == 1
    chain.wait(seconds=1)
    assert chain.read("letters").count() == 0 and chain.states()[1] == ("failed", 5)


def test_awaited_texts_of_two_streams(spark, tmp_path):
    """A claim gets the text that comes in its time; when the watermarks have passed, one without is given out as timed out."""
    claims, texts = tmp_path / "claims", tmp_path / "texts"

    def put(folder, k, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(folder))

    at = lambda minute: datetime.datetime(2026, 5, 17, 3) + datetime.timedelta(minutes=minute)
    c, x = "ticket_id string, claimed_at timestamp", "ticket_id string, text string, read_at timestamp"
    put(claims, 0, [("a", at(0)), ("b", at(0)), ("c", at(1))], c)
    put(texts, 0, [("a", "A", at(5)), ("c", "too late", at(90))], x)

    def run():
        left, right = spark.readStream.schema(c).parquet(str(claims)), spark.readStream.schema(x).parquet(str(texts))
        q = events.awaited(left, right).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert q.exception() is None
        return rows(spark.read.parquet(str(tmp_path / "out")).select("ticket_id", "text"))

    assert run() == [("a", "A")]
    put(claims, 1, [("d", at(300))], c)
    put(texts, 1, [("d", "D", at(301)), ("b", "far too late", at(300))], x)
    assert ("d", "D") in run()
    put(claims, 2, [("e", at(600))], c)
    put(texts, 2, [("e", "E", at(600))], x)
    assert run() == [("a", "A"), ("b", None), ("c", None), ("d", "D"), ("e", "E")]
    batch = events.awaited(spark.read.schema(c).parquet(str(claims)), spark.read.schema(x).parquet(str(texts)))
    assert rows(batch.select("ticket_id", "text")) == run()


def test_decoding_leaves_other_objects_alone(spark):
    data = spark.read.schema(tables.TICKET_EVENT).json(spark.sparkContext.parallelize([envelope("other/x", "1"), envelope("tickets/raw/u/x.jpg", "2"), upload(7, "3", user="u9")]))
    valid, dead = events.decode_events(data)
    assert rows(valid.select("ticket_id", "user_id", "messageId")) == [(ident(7), "u9", "3")] and rows(dead.select("reason")) == [("path is no ticket",)]


def test_events_are_decoded_once(spark):
    """Filters on the reason do not decode an envelope anew."""
    df = spark.createDataFrame([], "message struct<attributes:map<string,string>,data:string,messageId:string,publishTime:string>")
    for part in events.decode_events(df.union(df)):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") <= 2 and plan.count("unbase64") <= 2  # of each side of the union
