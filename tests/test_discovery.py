import pytest
from conftest import rows

from ontoweave.functions.kinds import sql_name
from ontoweave.operators import entities as E
from ontoweave.operators import keys as K
from ontoweave.operators import overlap as O
from ontoweave.operators import suggest as S
from ontoweave.operators import validate as V
from ontoweave.operators.keys import Dataset

DECLARED = "from_dataset string, from_column string, to_dataset string, to_column string"


@pytest.fixture
def suggest(from_dicts, frame):
    """A suggestion over ``(name, rows, source, system)`` tables, and its links as text."""

    def run(*tables, declared=None):
        found = [
            Dataset(f"d{i}", t[0], from_dicts(t[1]), t[2] if len(t) > 2 else "upload", t[3] if len(t) > 3 else "")
            for i, t in enumerate(tables)
        ]
        ids = {d.name: d.id for d in found}
        edges = frame([(ids[a], b, ids[c], d) for a, b, c, d in declared], DECLARED) if declared else None
        s = S.suggest_ontology(found, edges)
        return s, [f"{x.source}.{x.from_column}->{x.target}.{x.to_column}" for x in s.links]

    return run


def table(n, **columns):
    """``n`` rows of columns computed from the row number."""
    return [{c.replace("__", "-"): f(i) for c, f in columns.items()} for i in range(n)]


def test_declared_keys_count_whatever_their_names(suggest):
    s, _ = suggest(
        ("customers", table(5, id=lambda i: i + 1, name=lambda i: f"C{i}"), "postgres", "shop"),
        ("orders", table(5, order_id=lambda i: i + 1, buyer=lambda i: 9 if i % 2 else 1), "postgres", "shop"),
        ("Tickets", table(5, ticket_id=lambda i: i + 1, customer_id=lambda i: (i + 1) % 3 + 1)),
        declared=[("orders", "buyer", "customers", "id")],
    )
    assert sorted(e.name for e in s.entities) == ["Customer", "Order", "Ticket"]
    assert sorted((x.source, x.from_column, x.target, x.evidence) for x in s.links) == [
        ("order", "buyer", "customer", "declared"),
        ("ticket", "customer_id", "customer", "name"),
    ]


def test_declared_edges_match_tables_ignoring_case_and_schema(frame):
    known = frame(
        [("c", 0, "shop", "public.customers"), ("o", 1, "shop", "public.Orders"), ("x", 2, "other", "customers")],
        "dataset string, d int, system string, source_name string",
    )
    edges = frame(
        [
            ("shop", "orders", "buyer", "CUSTOMERS", "id"),
            ("shop", "orders", "buyer", "public.customers", "id"),
            ("shop", "orders", "parent", "orders", "id"),
            ("shop", "orders", "gone", "missing", "id"),
        ],
        "system string, table_name string, column_name string, referenced_table string, referenced_column string",
    )
    assert rows(K.declared_keys(known, edges)) == [("o", "buyer", "c", "id")]


def test_sources_state_their_links(spark, from_dicts):
    from ontoweave.sources import billing

    made = {
        "customers": table(4, customer_id=lambda i: f"cus_{i}"),
        "invoices": table(8, invoice_id=lambda i: f"in_{i}", customer_id=lambda i: f"cus_{i % 2}" if i < 2 else f"x{i}"),
    }
    found = [Dataset(n, f"Stripe · {n}", from_dicts(r), "stripe", "stripe") for n, r in made.items()]
    assert S.suggest_ontology(found).links == (), "too few values agree to believe it unasked"
    declared = K.declared_for(found, K.edges_of(spark, {"stripe": billing.relationships()}))
    assert rows(declared) == [("invoices", "customer_id", "customers", "customer_id")]
    (link,) = S.suggest_ontology(found, declared).links
    assert (link.evidence, link.matched, link.total) == ("declared", 2, 8)


def test_a_column_named_for_another_table(suggest):
    s, links = suggest(
        ("Customers", [{"id": "A", "name": "Acme"}, {"id": "B", "name": "Beta"}]),
        ("Orders", table(3, id=lambda i: i + 1, customer=lambda i: "A" if i < 2 else "B")),
    )
    assert links == ["order.customer->customer.id"] and s.links[0].evidence == "name"


def test_two_hop_paths(suggest):
    accounts = ["A", "B", "C"]
    users = [(f"u{n}", accounts[n % 3]) for n in range(1, 7)]
    other = {"A": "B", "B": "A", "C": "A"}
    _, links = suggest(
        ("Accounts", [{"account_id": a} for a in accounts]),
        ("Users", [{"user_id": u, "account_id": a} for u, a in users]),
        ("Tickets", [{"ticket_id": f"t{n}", "user_id": users[n % 6][0], "account_id": users[n % 6][1]} for n in range(12)]),
        ("Escalations", [{"escalation_id": f"e{n}", "user_id": users[n % 6][0], "account_id": other[users[n % 6][1]]} for n in range(12)]),
    )
    hops = {x.rsplit(".", 1)[0] for x in links}
    assert {"ticket.user_id->user", "escalation.user_id->user", "escalation.account_id->account"} <= hops
    assert "ticket.account_id->account" not in hops


def test_a_direct_link_stays_for_rows_its_path_misses(suggest):
    _, links = suggest(
        ("customers", table(30, customer_id=lambda i: f"cus_{i}"), "stripe", "stripe"),
        ("subscriptions", table(20, subscription_id=lambda i: f"sub_{i}", customer_id=lambda i: f"cus_{i}"), "stripe", "stripe"),
        (
            "invoices",
            table(
                100,
                invoice_id=lambda i: f"in_{i}",
                customer_id=lambda i: f"cus_{i % 20 if i < 60 else 20 + i % 10}",
                subscription_id=lambda i: f"sub_{i % 20}" if i < 60 else None,
            ),
            "stripe",
            "stripe",
        ),
    )
    assert "invoice.customer_id->customer.customer_id" in links


@pytest.mark.parametrize("customer, order", [("Customer ID", "Order ID"), ("customer-id", "order-id"), ("CustomerId", "OrderId")])
def test_spreadsheet_headers(suggest, customer, order):
    s, links = suggest(
        ("customers", [{customer: f"C{i}", "Name": f"N{i}"} for i in range(20)]),
        ("orders", [{order: f"O{i}", customer: f"C{i % 20}"} for i in range(50)]),
    )
    assert sorted(e.name for e in s.entities) == ["Customer", "Order"]
    assert links == [f"order.{customer}->customer.{customer}"]


def test_natural_and_last_resort_keys(suggest):
    s, _ = suggest(("products", table(20, sku=lambda i: f"SKU-{i}", title=lambda i: f"P{i}", price=lambda i: i)))
    assert (s.entities[0].name, s.entities[0].key) == ("Product", "sku")
    s, _ = suggest(("sales.csv", table(10, region=lambda i: f"R{i}", total=lambda i: i * 3)))
    assert [(e.name, e.key) for e in s.entities] == [("Sale", "region")]


def test_no_key_no_entity(suggest):
    s, _ = suggest(("dupes", [{"region": "R", "total": 1}] * 4))
    assert s.entities == () and s.unplaced == ("d0",)
    assert S.confirm_ontology(s).entities == ()


def test_size_never_makes_activity(suggest):
    dated = lambda n: table(n, order_id=lambda i: f"o{i}", customer_id=lambda i: f"c{i % 20}", placed=lambda i: f"2024-01-{i % 27 + 1:02}T00:00:00Z")
    customers = ("customers", table(20, customer_id=lambda i: f"c{i}"), "postgres", "shop")
    for n in (30, 3000):
        s, _ = suggest(customers, ("orders", dated(n), "postgres", "shop"))
        assert {e.name: e.kind for e in s.entities} == {"Customer": "record", "Order": "record"}


def test_nothing_connected():
    s = S.suggest_ontology([])
    assert s.entities == () and s.summary == "0 entities from 0 datasets across 0 sources."


def test_uploads_link_and_do_not_merge(suggest):
    s, links = suggest(
        ("customers", table(40, customer_id=lambda i: f"cus_{i}", name=lambda i: f"C{i}")),
        ("subscriptions", table(35, subscription_id=lambda i: f"sub_{i}", customer_id=lambda i: f"cus_{i}")),
    )
    assert [len(e.members) for e in s.entities] == [1, 1]
    assert links == ["subscription.customer_id->customer.customer_id"]
    assert s.summary.endswith("across 1 source.")


def test_serial_ids_do_not_merge(suggest):
    s, _ = suggest(
        ("users", table(100, id=lambda i: i + 1, email=lambda i: f"app{i}@a.example"), "postgres", "app"),
        ("users", table(80, id=lambda i: i + 1, email=lambda i: f"forum{i}@f.example"), "mysql", "forum"),
    )
    assert [e.name for e in s.entities] == ["User", "User (MySQL)"]
    assert not any(n.kind == "merged" for n in s.notes)


def test_extension_tables(suggest):
    s, links = suggest(
        ("users", table(30, user_id=lambda i: f"u{i}"), "postgres", "db"),
        ("user_profiles", table(25, user_id=lambda i: f"u{i}", bio=lambda i: f"b{i}"), "postgres", "db"),
        ("orders", table(60, order_id=lambda i: f"o{i}", user_id=lambda i: f"u{i % 30}"), "postgres", "db"),
        declared=[("user_profiles", "user_id", "users", "user_id")],
    )
    assert sorted(links) == ["order.user_id->user.user_id", "user_profile.user_id->user.user_id"]
    assert next(x for x in s.links if x.source == "user_profile").name == "extends"


def test_many_integer_tables(suggest):
    nouns = "user account order product invoice payment shipment review cart coupon vendor warehouse".split()
    tables = []
    for t, noun in enumerate(nouns):
        first, second = nouns[(t + 1) % 12] + "_id", nouns[(t + 5) % 12] + "_id"
        made = [
            {"id": i + 1, first: (i * 7919 + t) % 200 + 1, second: (i * 104729 + t) % 200 + 1, "country_id": i % 20 + 1}
            for i in range(200)
        ]
        tables.append((noun + "s", made, "postgres", "shop"))
    tables.append(("countries", table(20, id=lambda i: i + 1, name=lambda i: f"Country {i}"), "postgres", "shop"))
    _, links = suggest(*tables)
    to_country = [x for x in links if x.endswith("->country.id")]
    assert (len(to_country), len(links) - len(to_country)) == (12, 24)


def test_files_name_entities(suggest):
    s, _ = suggest(
        ("exports/2024/orders.csv", table(5, order_id=lambda i: f"o{i}")),
        ("customers.export", table(5, customer_id=lambda i: f"c{i}")),
    )
    assert sorted(e.name for e in s.entities) == ["Customer", "Order"]


# A small company whose records are spread over five systems, with planted gaps.


def company():
    n = 12
    accounts = [
        {
            "account_id": f"acct_{i}", "name": f"Firm {i}", "plan": "pro" if i % 2 else "free",
            "signup_campaign_id": (f"CMP-{i % 4}" if i == 3 else f"cmp-{i % 4}") if i < 11 else f"typo-{i}",
            "workos_organization_id": f"org_{i}", "stripe_customer_id": f"cus_{i}" if i < 10 else None,
        }
        for i in range(n)
    ]
    users = [
        {
            "user_id": f"usr_{i}", "account_id": f"acct_{i % n}", "workos_user_id": f"wu_{i}" if i < 36 else None,
            "email": f"person{i}@x.example", "role": "owner" if i < n else "member",
        }
        for i in range(38)
    ]
    organizations = [
        {"organization_id": f"org_{i}", "name": f"Firm {i} Ltd", "external_id": f"acct_{i}" if i < n else None}
        for i in range(n + 2)
    ]
    members = [
        {"user_id": f"wu_{i}", "email": f"person{i}@x.example" if i < 36 else f"guest{i}@y.example", "first_name": f"P{i}"}
        for i in range(38)
    ]
    customers = [
        {"customer_id": f"cus_{i}", "email": f"billing{i}@z.example", "metadata": {"account_id": f"acct_{i}", "tier": "a"}}
        for i in range(11)
    ]
    subscriptions = [
        {"subscription_id": f"sub_{i}", "customer_id": f"cus_{i}", "status": "active" if i % 3 else "canceled"}
        for i in range(11)
    ]
    invoices = [
        {"invoice_id": f"in_{i}", "customer_id": f"cus_{i % 11}", "subscription_id": f"sub_{i % 11}", "amount_paid": 100 * i}
        for i in range(44)
    ]
    tickets = [
        {
            "ticket_id": 4000 + i, "account_id": f"acct_{i % 38 % n}",
            "requester_email": f"Person{i % 38}@x.example" if i < 5 else f"person{i % 38}@x.example",
            "priority": "high" if i % 2 else "low",
        }
        for i in range(60)
    ]
    campaigns = [{"campaign_id": f"cmp-{i}", "name": f"Campaign {i}", "spend_usd": 10.5 * i} for i in range(4)]
    return [
        ("PlanetScale · accounts", accounts, "planetscale", "sample:planetscale"),
        ("PlanetScale · users", users, "planetscale", "sample:planetscale"),
        ("WorkOS · organizations", organizations, "workos", "sample:workos"),
        ("WorkOS · users", members, "workos", "sample:workos"),
        ("Stripe · customers", customers, "stripe", "sample:stripe"),
        ("Stripe · subscriptions", subscriptions, "stripe", "sample:stripe"),
        ("Stripe · invoices", invoices, "stripe", "sample:stripe"),
        ("S3 · support_tickets.csv", tickets, "s3", "sample:s3"),
        ("S3 · marketing_campaigns.csv", campaigns, "s3", "sample:s3"),
    ]


@pytest.fixture(scope="module")
def found(spark):
    import json

    out = []
    for i, (name, made, source, system) in enumerate(company()):
        lines = spark.createDataFrame([(json.dumps(r),) for r in made], "value string")
        out.append(Dataset(f"d{i}", name, spark.read.json(lines.rdd.map(lambda r: r[0])).cache(), source, system))
    return out


@pytest.fixture(scope="module")
def company_ontology(found):
    return S.suggest_ontology(found)


def test_company_entities(company_ontology):
    s = company_ontology
    assert {e.name for e in s.entities} == {"Account", "User", "Subscription", "Support ticket", "Campaign", "Invoice"}
    assert s.entities[0].name == "Account"
    account = next(e for e in s.entities if e.name == "Account")
    assert account.key == "account_id"
    assert [(m.name, m.matched, m.rows) for m in account.members] == [
        ("PlanetScale · accounts", 12, 12), ("WorkOS · organizations", 12, 14), ("Stripe · customers", 10, 11),
    ]
    assert account.members[2].via == S.Via("customer_id", "d0", "stripe_customer_id")
    assert "workos_name" in account.properties and "stripe_metadata" not in account.properties
    assert account.description == (
        "12 accounts from PlanetScale, joined with WorkOS organizations and Stripe customers."
    )
    user = next(e for e in s.entities if e.name == "User")
    assert [m.name for m in user.members] == ["PlanetScale · users", "WorkOS · users"]
    assert s.summary == (
        "6 entities from 9 datasets across 4 sources. Accounts combine PlanetScale, WorkOS and Stripe; "
        "users combine PlanetScale and WorkOS."
    )


def test_company_links(company_ontology):
    links = {(x.source, x.from_column): x for x in company_ontology.links}
    assert ("invoice", "customer_id") not in links, "invoices reach accounts through subscriptions"
    assert ("support_ticket", "account_id") not in links, "tickets reach accounts through their requester"
    requester = links["support_ticket", "requester_email"]
    assert (requester.name, requester.case_insensitive, requester.to_column) == ("requested by", True, "email")
    campaign = links["account", "signup_campaign_id"]
    assert (campaign.name, campaign.case_insensitive, campaign.matched, campaign.total) == ("came from", True, 11, 12)
    # Counted through the merge: one billing customer never joins an account.
    assert (links["subscription", "customer_id"].matched, links["subscription", "customer_id"].total) == (10, 11)


def test_company_notes(company_ontology):
    texts = [n.text for n in company_ontology.notes]
    assert (
        "Account combines PlanetScale accounts with WorkOS organizations (12 of 14 match, confirmed by external_id) "
        "and Stripe customers (10 of 11 match, confirmed by metadata.account_id)."
    ) in texts
    assert "User combines PlanetScale users with WorkOS users (36 of 38 match, confirmed by email)." in texts
    assert "2 WorkOS organizations don't match any account." in texts
    assert "1 campaign code only matches when ignoring case." in texts
    assert "5 requester emails only match when ignoring case." in texts
    assert "1 Stripe subscription has a customer_id that doesn't match any account." in texts


def test_suggestion_does_not_depend_on_input_order(found, company_ontology):
    assert S.suggest_ontology(found[::-1]) == company_ontology


def test_review(company_ontology):
    s = company_ontology
    left = S.confirm_ontology(s, ["campaign", "support_ticket"])
    assert not any("campaign code" in n.text or "requester" in n.text for n in left.notes)
    assert any("WorkOS organizations don't match" in n.text for n in left.notes)
    assert left.summary.startswith("4 entities from 7 datasets across 3 sources.")
    assert not any(x.target == "campaign" for x in left.links)
    with pytest.raises(ValueError, match="must stay"):
        S.confirm_ontology(s, [e.id for e in s.entities])
    with pytest.raises(ValueError, match="same name"):
        S.confirm_ontology(s, renamed={"user": "account"})
    with pytest.raises(ValueError, match="needs a name"):
        S.confirm_ontology(s, renamed={"user": " "})
    with pytest.raises(ValueError, match="has no entity"):
        S.confirm_ontology(s, ["nope"])


def test_company_bundle(spark, found, company_ontology):
    tables = {d.id: d.df for d in found}
    columns = {d.id: [(f.name, sql_name(f.dataType)) for f in d.df.schema.fields] for d in found}
    bundle = E.ontology_bundle(S.confirm_ontology(company_ontology, renamed={"account": "Customer"}), columns)
    assert {t.name for t in bundle.tables} == {
        "Customers (PlanetScale + WorkOS + Stripe)", "Users (PlanetScale + WorkOS)", "Support tickets (S3)", "Campaigns (S3)",
    }
    between = {(r.from_type, r.to_type): r for r in bundle.relationships}
    assert between["Subscription", "Customer"].to_column == "stripe_customer_id"
    asked = between["Support ticket", "User"]
    assert (asked.name, asked.from_column, asked.to_column) == ("requested by", "requester_email_key", "email_key")
    report = V.validate_bundle(tables, columns, bundle)
    assert [c for c in report if not c.passed] == []
    detail = {c.name: c.detail for c in report if c.kind == "relationship"}
    assert detail["requested by"].startswith("60/60 source objects matched")
    assert detail[between["Customer", "Campaign"].name].startswith("11/12 source objects matched; many-to-one")
    assert detail[between["Subscription", "Customer"].name].startswith("10/11")
    built = E.build_tables(bundle, tables, columns)
    merged = built[next(t.dataset for t in bundle.types if t.name == "Customer")]
    assert merged.count() == 12
    row = merged.where("account_id = 'acct_3'").first()
    assert (row["workos_name"], row["stripe_email"], row["signup_campaign_id_key"]) == ("Firm 3 Ltd", "billing3@z.example", "cmp-3")
    assert merged.where("account_id = 'acct_11'").first()["stripe_email"] is None


def test_type_moves_to_the_only_dataset_it_fits(frame):
    facts = V.dataset_facts(
        {
            "customers": frame([("A", "EU"), ("B", "NA")], "id string, region string"),
            "orders": frame([(1, "A", 10), (2, "A", 20)], "id int, customer string, amount int"),
        }
    )
    order = E.TypeDef("Order", "customers", "id", ("id", "amount"))
    fitting = E.TypeDef("Customer", "customers", "id", ("region",))
    derived = E.TypeDef("Merged", "pipeline_1", "id", ("amount",))
    moved = V.rehome([order, fitting, derived], facts, set())
    assert [t.dataset for t in moved] == ["orders", "customers", "pipeline_1"]


def test_failing_definitions_take_their_dependants_along():
    types = (E.TypeDef("A", "a", "id", ("id", "x")), E.TypeDef("B", "b", "id", ("id",)))
    bundle = E.Bundle(
        "", types=types,
        relationships=(E.RelationshipDef("r", "A", "B", "id", "id"), E.RelationshipDef("s", "A", "A", "id", "id")),
        actions=(E.ActionDef("edit b", "B", ("id",)), E.ActionDef("edit a", "A", ("x",))),
    )
    kept = V.drop_failing(bundle, [V.CheckResult("type", "B", False, "")])
    assert [t.name for t in kept.types] == ["A"]
    assert [r.name for r in kept.relationships] == ["s"] and [a.name for a in kept.actions] == ["edit a"]
    assert V.editable(types[0], ("x",)) and not V.editable(types[0], ("id",)) and not V.editable(types[0], ("y",))


def test_repeated_relationship_names():
    r = E.RelationshipDef
    named = E.unique_relationships(
        [r("owned by", "A", "U", "x", "y"), r("belongs to", "A", "B", "x", "y"), r("belongs to", "A", "C", "x", "y"),
         r("belongs to", "A", "C", "z", "y"), r("belongs to", "D", "B", "x", "y")]
    )
    assert [x.name for x in named] == ["owned by", "A belongs to", "A belongs to C", "A belongs to C 2", "D belongs to"]


def test_manual_descriptions_survive(frame):
    current = frame([("a", "Written by Ada", True), ("b", "old", False)], "dataset string, description string, manual boolean")
    made = frame([("a", "new a", ["x"]), ("b", "new b", ["y"]), ("c", "new c", [])], E.CATALOG)
    assert rows(E.merge_catalog(current, made), "dataset", "description") == [
        ("a", "Written by Ada"), ("b", "new b"), ("c", "new c"),
    ]


def test_overlap_is_symmetric_in_shared_values(found):
    columns = K.key_columns(K.column_facts(found)).orderBy("i").collect()
    shared = O.key_overlap({d.id: d.df for d in found}, columns)
    pairs = {(r["a"], r["b"]): (r["m_exact"], r["m_ci"]) for r in shared.collect()}
    assert pairs and all(pairs[b, a] == m for (a, b), m in pairs.items())


def test_coverage_counts_keys_and_pairs(frame):
    orders = frame([(1, "A"), (2, "A"), (3, "B"), (4, None), (5, "Z")], "id int, customer string")
    customers = frame([("A", 1), ("A", 2), ("B", 3), (None, 4)], "id string, n int")
    got = V.relationship_coverage(orders, customers, "id", "n", "customer", "id").first()
    assert got.asDict() == {"total": 5, "matched": 3, "pairs": 5}
    assert V.relationship_cardinality(orders, customers, "id", "id").first()["cardinality"] == "one-to-many"


def test_one_row_per_entity(frame):
    df = frame([("a", 1, 1), ("b", 1, None)], "k string, j int, n int")
    ok = [E.one_row_per_entity(df, c).first()["ok"] for c in ("k", "j", "n")]
    assert ok == [True, False, False]
    assert E.one_row_per_entity(df.where("false"), "k").first()["ok"]
