"""Training-data operators. Nothing outside this subpackage imports it."""


def queries():
    from strandmill.llm import registry

    return registry.queries()


def oracle_sql():
    from strandmill.llm import registry

    return registry.oracle_sql()
