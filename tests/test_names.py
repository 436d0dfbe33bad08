from ontoweave.functions import names as N


def test_names_read_as_words_whatever_their_style():
    for style in ["Customer ID", "customer-id", "customerId", "customer_id"]:
        assert N.words(style) == ["customer", "id"]
    assert N.stem("ticket_id", "support_tickets") == "ticket"
    assert N.stem("id", "support_tickets") == "ticket"
    assert N.noun("support_tickets") == "ticket"
    assert N.is_key("order_number") and N.is_key("Sku") and N.is_key("work-email")
    assert not N.is_key("name") and N.is_id("uuid") and not N.is_id("sku")


def test_entities_are_named_from_their_table():
    expected = {
        "support_tickets": "Support ticket",
        "sso_connections": "SSO connection",
        "marketing_campaigns": "Campaign",
        "categories": "Category",
        "addresses": "Address",
        "warehouses": "Warehouse",
        "movies": "Movie",
        "news": "News",
        "statuses": "Status",
        "": "Record",
    }
    assert {t: N.entity_name(t) for t in expected} == expected


def test_singular_and_plural():
    for many in ["companies", "boxes", "people", "analyses", "series", "cookies", "matches", "keys"]:
        assert N.plural(N.singular(many)) == many
    assert N.singular("status") == "status" and N.singular("analytics") == "analytics"
    assert N.plural("support ticket") == "support tickets"
    assert N.counted(1, "entity") == "1 entity" and N.counted(2000, "entity") == "2,000 entities"


def test_table_names():
    assert N.table_name("S3 · exports/2024/orders.csv") == "orders"
    assert N.table_name("public.orders", "postgres") == "orders"
    assert N.table_name("customers.export") == "customers"
    assert N.table_name("2024.10.orders.csv.gz") == "orders"


def test_stems_pair_shortened_nouns():
    assert N.same_stem("org", "organization") and N.same_stem("user", "user")
    assert not N.same_stem("or", "organization") and not N.same_stem("user", "order")


def test_link_verbs():
    verbs = {
        "requester_email": "requested by",
        "signup_campaign_id": "came from",
        "subscription_id": "for subscription",
        "customer_id": "billed to",
        "organization_id": "belongs to",
        "owner": "owned by",
        "distinct_id": "performed by",
        "sku": "references",
    }
    assert {c: N.link_name(c) for c in verbs} == verbs


def test_lists_and_labels():
    assert N.listed(["a"]) == "a" and N.listed(["a", "b", "c"]) == "a, b and c"
    assert N.dataset_label("organizations", "workos") == "WorkOS organizations"
    assert N.dataset_label("subscriptions", "stripe", 1) == "Stripe subscription"
    assert N.dataset_label("support_tickets", "upload") == "support tickets"
    assert N.uncapitalised("SSO connection") == "SSO connection"
