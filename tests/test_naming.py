import pytest

from tabloom.naming import (
    header_marks_identifier,
    namespace_name,
    normalize_headers,
    slugify,
    sql_identifier,
)


def test_portuguese_names():
    assert slugify("Recursos Humanos & Gestão") == "recursos-humanos-gestao"
    assert sql_identifier("Valor Total (R$)") == "valor_total_r"
    assert sql_identifier("1º Vencimento") == "col_1_vencimento"
    assert sql_identifier("%%%") == "campo"


def test_long_names_keep_a_digest():
    name = namespace_name("projeto" * 30, "dataset" * 30)
    assert len(name) <= 128 and name.startswith("d_")
    assert name == namespace_name("projeto" * 30, "dataset" * 30)
    assert name != namespace_name("projeto" * 30, "dataset" * 31)
    assert namespace_name("a-b", "c") == "d_a_b_c"


def test_slug_needs_a_letter():
    with pytest.raises(ValueError):
        slugify("***")


def test_repeated_and_blank_headers():
    assert normalize_headers(["id", "nome", "nome", "valor"]) == ["id", "nome", "nome_2", "valor"]
    assert normalize_headers(["id", "", "nome"]) == ["id", "col_2", "nome"]
    assert normalize_headers(["ID", "Valor Total", "Descrição", "Unidade%"]) == [
        "id", "valor_total", "descricao", "unidade",
    ]


@pytest.mark.parametrize(
    ("header", "marked"),
    [("id", True), ("Codigo Cliente", True), ("num_cpf", True), ("idade", False), ("valor", False), ("e-doc", True)],
)
def test_identifier_headers(header, marked):
    assert header_marks_identifier(header) is marked


def test_normalised_headers_are_unique():
    assert normalize_headers(["nome", "nome_2", "nome"]) == ["nome", "nome_2", "nome_3"]
